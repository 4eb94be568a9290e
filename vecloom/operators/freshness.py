"""Content-hash invalidation: which vectors no longer match their nodes, and which change-log entries are dealt with.

The three tables go in and come out; nothing is changed in place, so a run that dies leaves all as it was, and a
repeated run gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.predicates import hash_differs
from ..schema import DOC_KIND, DOC_VERIFY_MAX_ROWS


@dataclass(frozen=True)
class Invalidation:
    embeddings: DataFrame
    tombstones: DataFrame
    #: One row: unchanged, stale, orphaned, deferred, not_embedded, doc_stale, removed_any.
    report: DataFrame
    #: Embeddings with their `fate`: keep, orphan, stale or doc_stale.
    fates: DataFrame


def invalidate(
    nodes: DataFrame, embeddings: DataFrame, tombstones: DataFrame, ack: bool = True, verify_docs: bool = True, hash_fn: hashing.HashFn = hashing.text_hash, doc_cap: int = DOC_VERIFY_MAX_ROWS
) -> Invalidation:
    """Orphans go first, then vectors of logged nodes whose text has changed, then those of prose whose text has changed.

    A logged node without a vector is dealt with; with a vector but no text, it and its log entries wait. Entries of
    missing nodes are dealt with. Digests are worked out before any shuffle; texts never take part in a join.
    """
    logged = tombstones.select("node_id").distinct().withColumn("logged", F.lit(True))
    known = nodes.select(F.col("id").alias("node_id"), "kind", hash_fn(F.col("embed_text")).alias("digest"), F.lit(True).alias("exists"))
    marked = known.join(logged, "node_id", "left")
    rows = embeddings.join(marked, "node_id", "left")
    wrong = F.col("digest").isNotNull() & hash_differs(F.col("text_hash"), F.col("digest"))
    stale = F.col("logged") & wrong
    first = F.when(F.col("exists").isNull(), "orphan").when(stale, "stale")
    if verify_docs:
        docs_left = rows.filter(F.col("exists") & (F.col("kind") == DOC_KIND) & first.isNull()).count()
        verify_docs = docs_left <= doc_cap
    if verify_docs:
        first = first.when((F.col("kind") == DOC_KIND) & wrong, "doc_stale")
    fates = rows.withColumn("fate", first.otherwise("keep")).select(*embeddings.columns, "fate")

    per_node = fates.filter("fate <> 'orphan'").groupBy("node_id").agg(F.count(F.lit(1)).alias("vectors"), F.sum((F.col("fate") == "stale").cast("int")).alias("bad"))
    checked = marked.filter("logged").join(per_node, "node_id", "left").select("node_id", "digest", F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("bad", F.lit(0)).alias("bad"))
    some, text = F.col("vectors") > 0, F.col("digest").isNotNull()
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    by_node = checked.agg(count(some & text & (F.col("bad") == 0), "unchanged"), count(some & ~text, "deferred"), count(~some, "not_embedded"))
    by_row = fates.agg(*(count(F.col("fate") == f, name) for f, name in (("stale", "stale"), ("orphan", "orphaned"), ("doc_stale", "doc_stale"))))
    report = by_node.join(by_row).withColumn("removed_any", F.col("stale") + F.col("orphaned") + F.col("doc_stale") > 0)  # one row each
    waiting = checked.filter(some & ~text).select("node_id")
    left = tombstones.join(waiting, "node_id", "left_semi") if ack else tombstones
    return Invalidation(fates.filter("fate = 'keep'").drop("fate"), left, report, fates)


def unacknowledged(log: DataFrame, acked: DataFrame) -> DataFrame:
    """Entries of the log (node_id, deleted_at) that are later than those of their node that were dealt with.

    acked: node_id, deleted_at, once a node. An entry without a time is never taken as dealt with.
    """
    before = acked.select("node_id", F.col("deleted_at").alias("until"))
    return log.join(before, "node_id", "left").filter(F.col("until").isNull() | F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("until"))).drop("until")


def acknowledged(log: DataFrame, left: DataFrame) -> DataFrame:
    """What was dealt with after a run over the whole log that has left `left`: the last time of each node that doesn't wait."""
    done = log.join(left.select("node_id").distinct(), "node_id", "left_anti")
    return done.groupBy("node_id").agg(F.max("deleted_at").alias("deleted_at")).filter("deleted_at IS NOT NULL")
