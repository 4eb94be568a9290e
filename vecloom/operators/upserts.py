"""Writes as set operations on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import hash_differs

KEY = ["node_id", "model_id"]


def fold(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All of many writes in one step. `at` of a new row is its write's time, negative where it only adds what is not there.

    Of a key's rows the latest that replaces wins, else the old one, else the earliest that adds. Ties go by the other columns.
    """
    key = key or KEY
    rest = [c for c in old.columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct("at", *sorted(rest, reverse=True))).alias("won"))
    won = one.select(*key, "won.at", *(F.col(f"won.{c}").alias(c) for c in rest))
    put, add = won.filter("at >= 0").drop("at"), won.filter("at < 0").drop("at")
    return old.join(put.select(*key), key, "left_anti").unionByName(put).unionByName(add.join(old.select(*key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """New rows win."""
    return new.unionByName(old.join(new.select(*(key or KEY)).distinct(), key or KEY, "left_anti"), allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Old rows win; of new rows with one key, one is taken."""
    key = key or KEY
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def delete_stale(embeddings: DataFrame, digests: DataFrame) -> DataFrame:
    """Without the rows, of any model, whose hash is not the digest given for their node. digests: (node_id, digest)."""
    return embeddings.join(digests, "node_id", "left").filter(F.col("digest").isNull() | ~hash_differs(F.col("text_hash"), F.col("digest"))).drop("digest")


def delete_orphans(embeddings: DataFrame, nodes: DataFrame) -> DataFrame:
    return embeddings.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def acknowledge(tombstones: DataFrame, resolved: DataFrame) -> DataFrame:
    return tombstones.join(resolved.select("node_id").distinct(), "node_id", "left_anti")
