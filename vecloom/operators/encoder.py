"""Encoders, their registry and resolver, and the stage that runs one over a table."""

from __future__ import annotations

import hashlib
import os
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.vectors import pooled, unit
from ..schema import MAX_SEQ, PREF_ACCELERATED, PREF_PREFERRED_CPU, PREF_UNIVERSAL_CPU
from ..sources.descriptor import Descriptor
from .batching import budget_ranges

VERSION = "1.0.0"


class Encoder(Protocol):
    name: str
    accelerated: bool
    dim: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


def single_submitter(encoder: Encoder) -> bool:
    return getattr(encoder, "single_submitter", encoder.accelerated)


Tokenise = Callable[[list[str]], list[list[int]]]
Forward = Callable[[np.ndarray, np.ndarray], np.ndarray]


def token_batch(ids: list[list[int]], most: int = MAX_SEQ) -> tuple[np.ndarray, np.ndarray]:
    """Ids cut at `most`, filled with 0 on the right up to the longest, and their mask."""
    ids = [x[:most] for x in ids]
    out = np.zeros((len(ids), max(map(len, ids), default=0)), np.int64)
    mask = np.zeros_like(out)
    for i, x in enumerate(ids):
        out[i, : len(x)] = x
        mask[i, : len(x)] = 1
    return out, mask


def run_model(texts: list[str], tokenise: Tokenise, forward: Forward, d: Descriptor) -> np.ndarray:
    """Tokens, forward pass, pooling, the first output_dim values, unit length."""
    if not texts:
        return np.zeros((0, d.output_dim), np.float32)
    ids, mask = token_batch(tokenise(texts))
    hidden = forward(ids, mask)
    if hidden.shape != (*ids.shape, d.dim):
        raise ValueError(f"the model gave {hidden.shape}, not {(*ids.shape, d.dim)}")
    return unit(pooled(hidden, mask, d.pooling)[:, : d.output_dim]).astype(np.float32)


class HashEncoder:
    """A deterministic encoder without a model: each word stands for a fixed pseudo-random vector. For tests."""

    name, accelerated = "hash", False

    def __init__(self, d: Descriptor):
        self.d, self.dim = d, d.output_dim

    @staticmethod
    def _tokens(texts: list[str]) -> list[list[int]]:
        return [[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") for w in t.lower().split()] or [0] for t in texts]

    def _forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = ids[..., None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.d.dim, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return run_model(texts, self._tokens, self._forward, self.d)

    def embed_query(self, text: str) -> np.ndarray:
        return run_model([self.d.query_prefix + text], self._tokens, self._forward, self.d)[0]


class OnnxEncoder:
    """model.onnx and tokenizer.json of a model folder, on the CPU."""

    name, accelerated = "onnx-cpu", False

    def __init__(self, folder: Path, d: Descriptor):
        import onnxruntime
        from tokenizers import Tokenizer

        self.d, self.dim = d, d.output_dim
        self.session = onnxruntime.InferenceSession(str(folder / "model.onnx"), providers=["CPUExecutionProvider"])
        self.tokenizer = Tokenizer.from_file(str(folder / "tokenizer.json"))
        self.tokenizer.no_padding()
        self.tokenizer.enable_truncation(MAX_SEQ)

    def _tokens(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts)]

    def _forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feeds = [ids, mask, np.zeros_like(ids)][: self.d.n_inputs]
        return self.session.run(None, {i.name: x for i, x in zip(self.session.get_inputs(), feeds, strict=True)})[0]

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return run_model(texts, self._tokens, self._forward, self.d)

    def embed_query(self, text: str) -> np.ndarray:
        return run_model([self.d.query_prefix + text], self._tokens, self._forward, self.d)[0]


@dataclass(frozen=True)
class Factory:
    """One engine of the registry. build() gives an encoder, or None where it declines; it may raise."""

    engine: str
    preference: int
    build: Callable[[Path | None, Descriptor], Encoder | None]
    #: None: any.
    families: tuple[str, ...] | None = None

    def can_run(self, family: str) -> bool:
        return self.families is None or family in self.families


def _onnx(folder: Path | None, d: Descriptor) -> Encoder | None:
    return OnnxEncoder(folder, d) if folder and (folder / "model.onnx").exists() else None


#: The engines of this package: a universal one, and the hash encoder for the family of tests.
ENGINES = (Factory("hash", PREF_PREFERRED_CPU, lambda folder, d: HashEncoder(d), ("hash",)), Factory("onnx-cpu", PREF_UNIVERSAL_CPU, _onnx))


@dataclass(frozen=True)
class Choice:
    """What a deployment wishes: one engine only, or other ranks than the engines' own preferences."""

    only: str | None = None
    ranks: tuple[tuple[str, int], ...] = ()

    def table(self, engines: Iterable[Factory]) -> list[tuple[int, Factory]]:
        """The engines left, best first, equal ranks in the order given."""
        ranks = dict(self.ranks)
        left = [(ranks.get(f.engine, f.preference), f) for f in engines if self.only in (None, f.engine)]
        return sorted(left, key=lambda row: row[0], reverse=True)


def chosen(setting: str | None, engines: Iterable[Factory] = ENGINES) -> Choice:
    """The name of an engine asks for that one only; nothing or `auto` leaves all, and so does, with a warning, any other word."""
    word = (setting or "auto").strip().lower() or "auto"
    if word in {f.engine for f in engines}:
        return Choice(only=word)
    if word != "auto":
        warnings.warn(f"there is no engine {setting!r}; all are considered", stacklevel=2)
    return Choice()


def resolve(engines: Iterable[Factory], folder: Path | None, d: Descriptor, choice: Choice | None = None) -> Encoder:
    """The best-ranked engine's encoder, of those that can run the family and don't decline or fail."""
    engines, met = list(engines), {}
    for _, f in (choice or Choice()).table(engines):
        if not f.can_run(d.family):
            met[f.engine] = "other families only"
            continue
        try:
            built = f.build(folder, d)
        except Exception as e:  # the next engine may do; if none does, all reasons are told
            met[f.engine] = repr(e)
            continue
        if built is not None:
            return built
        met[f.engine] = "declined"
    raise RuntimeError(f"nothing to encode {d.family!r} with: " + (", ".join(f"{k} ({v})" for k, v in met.items()) or "no engine is left"))


def capabilities(engines: Sequence[Factory] = ENGINES) -> dict:
    return {
        "plugin_version": VERSION,
        "capabilities_version": 1,
        "engines": [f.engine for f in engines],
        "families": list(dict.fromkeys(x for f in engines for x in f.families or ())),
        "universal_onnx": any(f.families is None for f in engines),
        "accelerated_compiled": any(f.preference >= PREF_ACCELERATED for f in engines),
    }


def backend_label(model_id: str, dim: int) -> str:
    return f"{model_id} fp32 dim-{dim}"


_built: dict[tuple, Encoder] = {}


def worker_encoder(folder: str | None, d: Descriptor) -> Encoder:
    """One encoder for each Python worker."""
    key = (folder, d)
    if key not in _built:
        _built[key] = resolve(ENGINES, Path(folder) if folder else None, d, chosen(os.environ.get("VECLOOM_ENGINE")))
    return _built[key]


def embed(items: DataFrame, d: Descriptor, model_id: str, folder: str | None = None, budget: int = 4096, hash_fn: hashing.HashFn = hashing.text_hash) -> DataFrame:
    """node_id, model_id, embedding, text_hash of rows with id, text, est_tokens. Texts of like length share a batch."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(folder, d)
        for pdf in frames:
            if not len(pdf):
                continue
            number = np.array(budget_ranges(pdf["est_tokens"].clip(upper=MAX_SEQ).tolist(), budget))
            out = np.concatenate([encoder.embed_documents(pdf["text"][number == b].tolist()) for b in range(number[-1] + 1)])
            yield pd.DataFrame({"node_id": pdf["id"], "model_id": model_id, "embedding": list(out), "text_hash": pdf["text_hash"]})

    rows = items.select("id", "text", "est_tokens", hash_fn(F.col("text")).alias("text_hash")).sortWithinPartitions("est_tokens", "id")
    return rows.mapInPandas(run, "node_id long, model_id string, embedding array<float>, text_hash string")
