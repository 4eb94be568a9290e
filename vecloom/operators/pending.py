"""Which nodes still need a vector, and their text with that of their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..schema import NEIGHBOUR_CHARS, NEIGHBOURS


def neighbour_signatures(nodes: DataFrame, edges: DataFrame, of: str, name: str) -> DataFrame:
    """Per node (`of` = dst: its callers, src: its callees) the first signatures, by neighbour id and edge kind, as one text.

    The rank is cut before the shuffle (a group limit on both sides), so a hub's neighbours don't meet in one task.
    """
    other = "src" if of == "dst" else "dst"
    named = nodes.filter(~P.structural(F.col("kind"))).select(F.col("id").alias("other"), F.substring("signature", 1, NEIGHBOUR_CHARS).alias("sig"))
    pairs = edges.select(F.col(of).alias("id"), F.col(other).alias("other"), F.col("kind").alias("edge"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("other", "edge"))
    first = pairs.join(named, "other").withColumn("rank", rank).filter(F.col("rank") <= NEIGHBOURS)
    return first.groupBy("id").agg(F.expr("listagg(sig, ', ') WITHIN GROUP (ORDER BY rank)").alias(name))


def candidates(nodes: DataFrame, embeddings: DataFrame, model_id: str, phase: tuple[int, int] | None = None, where: Column | None = None) -> DataFrame:
    """Embeddable nodes without a vector of this model."""
    have = embeddings.filter(F.col("model_id") == model_id).select(F.col("node_id").alias("id"))
    left = nodes.filter(P.embeddable() & P.in_phase(phase))
    return (left if where is None else left.filter(where)).join(have, "id", "left_anti")


def enriched(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen nodes with callers and callees; only their own edges are looked at."""
    ids = chosen.select("id")
    callers = neighbour_signatures(nodes, edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "dst", "callers")
    callees = neighbour_signatures(nodes, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"), "src", "callees")
    return chosen.join(callers, "id", "left").join(callees, "id", "left")


def pending(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, model_id: str, phase: tuple[int, int] | None = None, where: Column | None = None) -> DataFrame:
    """id, text, est_tokens, not_test, shell_number of each pending node. Order with serial_order() or parallel_order()."""
    rows = enriched(nodes, edges, candidates(nodes, embeddings, model_id, phase, where))
    text = T.embed_text()
    not_test = F.when(P.in_tests(F.col("path")), 0).otherwise(1)
    return rows.select("id", text.alias("text"), T.estimated_tokens(text).alias("est_tokens"), not_test.alias("not_test"), "shell_number")


def serial_order() -> list[Column]:
    """Tests last, then by falling shell number."""
    return [F.desc("not_test"), F.desc("shell_number"), F.asc("id")]


def parallel_order() -> list[Column]:
    return [F.desc("shell_number"), F.asc("id")]

