"""The change log as a stream: each micro-batch of deletions invalidates what it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import hashing
from ..operators import freshness
from ..schema import TOMBSTONES
from ..sources.store import TRIES, VECTORS, Conflict, Store


def read_log(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """An append-only folder of Parquet files of tombstones."""
    reader = spark.readStream.schema(TOMBSTONES)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def follow(log: DataFrame, store: Store, nodes: Callable[[], DataFrame], checkpoint: str, hash_fn: hashing.HashFn = hashing.text_hash, verify_docs: bool = True) -> StreamingQuery:
    """Starts a query that takes all there is and ends.

    Entries that wait are kept in the store's `waiting` table and join the next batch. A batch that runs twice finds
    its stale vectors gone and changes nothing.
    """

    def batch(entries: DataFrame, number: int) -> None:
        waiting = store.read("waiting")
        entries = entries if waiting is None else entries.unionByName(waiting)
        for _ in range(TRIES):
            view = store.view()
            done = freshness.invalidate(nodes(), view.frame, entries, hash_fn=hash_fn, verify_docs=verify_docs)
            try:
                if done.report.first().removed_any:
                    store.replace_embeddings(done.embeddings, view)
            except Conflict:
                continue
            store.publish(done.tombstones.distinct(), "waiting")
            for name in (VECTORS, "waiting"):
                store.sweep(name)
            return
        raise Conflict(VECTORS)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_tagged(spark: SparkSession, tag: str, work: Callable[[], object]) -> object:
    """Runs work under a tag by which cancel() stops it."""
    spark.sparkContext.addJobTag(tag)
    try:
        return work()
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
