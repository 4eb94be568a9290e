"""Full-text candidates: nodes whose signature contains one of the query's longest words, ranked by BM25.

A document's length is its number of trigrams; a term's frequency is how often it occurs as a substring, whatever case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..schema import FTS_CANDIDATES

# BM25's parameters and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def terms_of(nodes: DataFrame, query: str) -> list[str]:
    return nodes.sparkSession.range(1).select(search_terms(F.lit(query)).alias("t")).first()["t"]


def _times(text: Column, term: str) -> Column:
    """Non-overlapping occurrences."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)


def candidates(nodes: DataFrame, query: str, limit: int = FTS_CANDIDATES, column: str = "signature") -> DataFrame:
    """node_id, score, rank of the best candidates. One pass counts (rows, length, rows of each term), one scores and keeps the best."""
    terms = [t.lower() for t in terms_of(nodes, query)]
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    if not terms:
        return nodes.select(F.col("id").alias("node_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    size = F.greatest(F.length(text) - 2, F.lit(0))
    has = lambda t: text.contains(t)
    n, mean, *met = nodes.agg(F.count(F.lit(1)), F.avg(size), *(F.sum(has(t).cast("long")) for t in terms)).first()
    score = F.lit(0.0)
    for t, m in zip(terms, met, strict=True):
        m = m or 0
        idf = F.greatest(F.log((F.lit(float(n)) - m + 0.5) / (F.lit(float(m)) + 0.5)), F.lit(LEAST_IDF))
        f = _times(text, t)
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * size / F.lit(mean or 1.0)))
    some = F.lit(False)
    for t in terms:
        some = some | has(t)
    best = nodes.filter(some).select(F.col("id").alias("node_id"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")))  # over `limit` rows
