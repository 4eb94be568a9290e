"""A model's descriptor: model.toml."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path


#: The words of `macos_engine`, and what each asks for on that platform: (the only engine, ranks of engines).
PLATFORM_RULES: dict[str, tuple[str | None, dict[str, int]]] = {
    "auto": (None, {"tract": 101}),
    "tract": ("tract", {}),
    "ort": (None, {}),
}


@dataclass(frozen=True)
class Descriptor:
    dim: int
    pooling: str
    n_inputs: int
    query_prefix: str = ""
    truncate_dim: int = 0
    family: str = "bert"
    macos_engine: str = "auto"

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError("dim has to be positive")
        if self.pooling not in ("cls", "mean"):
            raise ValueError(f"unknown pooling {self.pooling!r}")
        if self.n_inputs not in (2, 3):
            raise ValueError("n_inputs has to be 2 or 3")
        if not 0 <= self.truncate_dim <= self.dim:
            raise ValueError("truncate_dim has to be between 0 and dim")
        if not self.family.strip():
            raise ValueError("family has to be named")
        if self.macos_engine not in PLATFORM_RULES:
            raise ValueError(f"unknown macos_engine {self.macos_engine!r}")

    @property
    def output_dim(self) -> int:
        return self.truncate_dim or self.dim


def parse(text: str) -> Descriptor:
    """Unknown keys are passed over; missing ones without a default raise."""
    have = tomllib.loads(text)
    return Descriptor(**{k: v for k, v in have.items() if k in Descriptor.__dataclass_fields__})


def load(folder: str | Path) -> Descriptor:
    return parse((Path(folder) / "model.toml").read_text())
