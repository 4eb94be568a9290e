"""The rules of the command line."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_MODEL = "bge-small-en-v1.5"
BUSY_TIMEOUT_MS = 120_000


class UsageError(Exception):
    """A wrong command line; the process ends with 1."""


@dataclass
class Options:
    mode: str | None = None  # version, capabilities, reindex, rebuild or serve
    db: str | None = None
    embed_db: str | None = None
    model_id: str = DEFAULT_MODEL
    phase: tuple[int, int] | None = None
    shard: tuple[int, int] | None = None
    rows: tuple[int, int] | None = None
    parallel: int | None = None
    cancel_sentinel: str | None = None
    rebuild_on_cancel: bool = False
    busy_timeout_ms: int = BUSY_TIMEOUT_MS


def _number(flag: str, word: str | None, least: int | None = None) -> int:
    try:
        n = int(word)
    except (TypeError, ValueError):
        raise UsageError(f"{flag} takes a whole number") from None
    if least is not None and n < least:
        raise UsageError(f"{flag} takes a number from {least} on")
    return n


def parse(args: list[str]) -> Options:
    """Version comes before everything, capabilities before all but that; of two phases the last holds."""
    if "--version" in args or "-V" in args:
        return Options("version")
    if "--capabilities" in args:
        return Options("capabilities")
    o, paths, start, end = Options(), {}, None, None
    rest = iter(args)
    for flag in rest:
        value = None
        if flag != "--rebuild-on-cancel":
            value = next(rest, None)
        match flag:
            case "--reindex" | "--rebuild-index" | "--db-path" | "--embed-db" | "--model-id" | "--cancel-sentinel":
                if value is None:
                    raise UsageError(f"{flag} takes a value")
                paths[flag] = value
            case "--phase1" | "--phase2":
                o.phase = (int(flag[-1]), _number(flag, value, 0))
            case "--shard":
                i, slash, n = (value or "").partition("/")
                if not slash:
                    raise UsageError("--shard takes <index>/<total>")
                o.shard = (_number(flag, i, 0), _number(flag, n, 1))
                if o.shard[0] >= o.shard[1]:
                    raise UsageError("--shard: the index has to be below the total")
            case "--row-start":
                start = _number(flag, value)
            case "--row-end":
                end = _number(flag, value)
            case "--parallel":
                o.parallel = _number(flag, value, 1)
            case "--busy-timeout-ms":
                o.busy_timeout_ms = _number(flag, value, 0)
            case "--rebuild-on-cancel":
                o.rebuild_on_cancel = True
            case _:
                raise UsageError(f"unknown argument: {flag}")
    reindex, rebuild = paths.get("--reindex"), paths.get("--rebuild-index")
    o.embed_db, o.model_id, o.cancel_sentinel = paths.get("--embed-db"), paths.get("--model-id", o.model_id), paths.get("--cancel-sentinel")
    if (start is None) != (end is None):
        raise UsageError("--row-start and --row-end go together")
    o.rows = None if start is None else (start, end)
    rules = [
        (o.rows and start >= end, "--row-start has to be below --row-end"),
        (o.shard and not reindex, "--shard needs --reindex"),
        (o.rows and not reindex, "--row-start and --row-end need --reindex"),
        (o.rows and o.shard, "--shard excludes --row-start and --row-end"),
        (o.parallel and (o.shard or o.rows), "--parallel excludes --shard and --row-start"),
        (o.parallel and not reindex, "--parallel needs --reindex"),
        (o.cancel_sentinel and not o.parallel, "--cancel-sentinel needs --parallel"),
        (o.rebuild_on_cancel and not o.cancel_sentinel, "--rebuild-on-cancel needs --cancel-sentinel"),
        (reindex and rebuild, "--reindex excludes --rebuild-index"),
        (not (reindex or rebuild or paths.get("--db-path")), "--db-path is needed"),
    ]
    for broken, message in rules:
        if broken:
            raise UsageError(message)
    o.mode = "rebuild" if rebuild else "reindex" if reindex else "serve"
    o.db = rebuild or reindex or paths["--db-path"]
    return o
