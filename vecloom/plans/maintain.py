"""The lifecycle of the vectors: reindex what is pending, rebuild the search spaces, resume after a stop."""

from __future__ import annotations

import threading
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.predicates import decodable, in_rows, in_shard
from ..operators import encoder, freshness, knn, pending
from ..operators.batching import token_budget
from ..sources.descriptor import Descriptor
from ..schema import PENDING_CHUNK_ROWS
from ..sources.graph import Graph
from ..sources.store import TRIES, VECTORS, Conflict, Store
from ..streaming.tombstones import cancel, run_tagged

SPACES = ("code", "docs")
#: Turns of a run at most; each reads its own part of a written table and stores its vectors.
MAX_TURNS = 64
POLL_SECONDS = 0.25


@dataclass(frozen=True)
class Outcome:
    #: rebuilt, nothing pending, worker done, or cancelled.
    state: str
    pending: int = 0
    report: dict | None = None
    #: Rows of nodes that can't be worked with.
    skipped: int = 0


def refresh(store: Store, g: Graph, ack: bool = True, hash_fn: hashing.HashFn = hashing.text_hash) -> tuple[dict, DataFrame]:
    """Invalidates the stored vectors; gives the report and the tombstones that are left.

    The log itself is only read. With `ack`, what was dealt with is stored, and left out by the next run.
    """
    acked = store.read("acknowledged")
    log = g.tombstones if acked is None else freshness.unacknowledged(g.tombstones, acked)
    for _ in range(TRIES):
        view = store.view()
        done = freshness.invalidate(g.nodes, view.frame, log, ack=ack, hash_fn=hash_fn)
        report = done.report.first().asDict()
        try:
            if report["removed_any"]:
                store.replace_embeddings(done.embeddings, view)
        except Conflict:
            continue
        if ack and not log.isEmpty():
            store.publish(freshness.acknowledged(g.tombstones, done.tombstones), "acknowledged")
            store.sweep("acknowledged")
        return report, done.tombstones
    raise Conflict(VECTORS)


def rebuild(store: Store, g: Graph, model_id: str, check: bool = True, hash_fn: hashing.HashFn = hashing.text_hash) -> dict[str, int]:
    """Publishes both spaces of a model, an empty one where a space has lost its last vector. Log entries stay.

    Fails where the model has no vector at all.
    """
    if check:
        refresh(store, g, ack=False, hash_fn=hash_fn)
    store.compact()
    for name in (VECTORS, "meta"):
        store.sweep(name)
    spaces = {s: knn.space_vectors(g.nodes, store.embeddings(), model_id, s) for s in SPACES}
    counts = {s: df.count() for s, df in spaces.items()}
    if not any(counts.values()):
        raise RuntimeError(f"no vectors of {model_id}")
    for s, df in spaces.items():
        store.publish(df, f"index-{model_id}-{s}")
        store.sweep(f"index-{model_id}-{s}")
    store.put("current_embed_model", model_id)
    return counts


def embed_in_turns(store: Store, todo: DataFrame, n: int, embed: Callable[[DataFrame], DataFrame], cancelled: Callable[[], bool], chunk_rows: int) -> bool:
    """Embeds n rows turn by turn; what a turn has stored stays when the run is killed or cancelled. Gives whether it was cancelled.

    `cancelled` is asked every POLL_SECONDS; the jobs of the turn under way are then stopped.
    """
    if cancelled():
        return True
    turns = max(1, min(MAX_TURNS, -(-n // chunk_rows)))
    parts, drop = [todo], lambda: None
    if turns > 1:
        parked, drop = store.park(todo.withColumn("turn", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(turns)).cast("int")), "pending", "turn")
        parts = [parked.filter(F.col("turn") == t).drop("turn") for t in range(turns)]
    spark, tag = store.spark, f"vecloom-{uuid.uuid4().hex}"
    over, stop = threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(POLL_SECONDS):
            if cancelled():
                stop.set()
                cancel(spark, tag)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        for part in parts:
            if stop.is_set() or cancelled():
                return True
            try:
                run_tagged(spark, tag, lambda part=part: store.put_embeddings(embed(part)))
            except Exception:
                if stop.is_set():
                    return True
                raise
        return cancelled()
    finally:
        over.set()
        watcher.join()
        drop()


def reindex(
    store: Store,
    g: Graph,
    model_id: str,
    d: Descriptor,
    folder: str | None = None,
    phase: tuple[int, int] | None = None,
    shard: tuple[int, int] | None = None,
    rows: tuple[int, int] | None = None,
    parallel: int = 1,
    cancelled: Callable[[], bool] = lambda: False,
    rebuild_on_cancel: bool = False,
    hash_fn: hashing.HashFn = hashing.text_hash,
    chunk_rows: int = PENDING_CHUNK_ROWS,
) -> Outcome:
    """Embeds what is pending. A worker (of a shard or a range of rows) neither invalidates nor builds spaces.

    What is pending is worked out anew by the absence of vectors, so a run that was killed is made up for by the next.
    Rows that can't be worked with are passed over and counted; where there are no others, it fails.
    """
    good, skipped = g.nodes.agg(F.count_if(decodable()), F.count_if(~decodable())).first()
    if skipped and not good:
        raise ValueError(f"none of {skipped} nodes can be read")
    g = Graph(g.nodes.filter(decodable()), g.edges, g.tombstones, g.embeddings)
    worker = shard is not None or rows is not None
    report = None if worker else refresh(store, g, hash_fn=hash_fn)[0]
    where = in_shard(*shard) if shard else in_rows(*rows) if rows else None
    todo = pending.pending(g.nodes, g.edges, store.embeddings(), model_id, phase, where)
    n = todo.count()
    if n == 0:
        missing = not worker and any(store.current(f"index-{model_id}-{s}") is None for s in SPACES)
        if worker:
            return Outcome("worker done", skipped=skipped)
        if report["removed_any"] or (missing and not (phase and phase[0] == 2)):
            rebuild(store, g, model_id, check=False)
            return Outcome("rebuilt", 0, report, skipped)
        store.put("current_embed_model", model_id)
        return Outcome("nothing pending", 0, report, skipped)
    label = encoder.backend_label(model_id, d.output_dim)
    before = store.record_backend(label)
    if before:
        warnings.warn(f"earlier vectors were made by {before}, these by {label}", stacklevel=2)
    embed = lambda part: encoder.embed(part, d, model_id, folder, token_budget(parallel), hash_fn)
    stopped = embed_in_turns(store, todo, n, embed, cancelled, chunk_rows)
    if worker:
        return Outcome("worker done", n, skipped=skipped)
    if stopped and not rebuild_on_cancel:
        return Outcome("cancelled", n, report, skipped)
    rebuild(store, g, model_id, check=False)
    return Outcome("cancelled" if stopped else "rebuilt", n, report, skipped)


def counts(g: Graph, embeddings: DataFrame, model_id: str) -> DataFrame:
    """space, n of a model's vectors."""
    parts = [knn.space_vectors(g.nodes, embeddings, model_id, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("space"), "n") for s in SPACES]
    return parts[0].unionByName(parts[1])
