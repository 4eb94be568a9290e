"""The text of a node, token estimates, and search terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FTS_MIN_BYTES, FTS_TERMS, MAX_SEQ, ROWS_OF_SEQ


def _part(label: str, value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    return F.when(value != "", F.concat(F.lit(f" | {label}: "), value)).otherwise("")


def node_text(kind: str = "kind", signature: str = "signature", path: str = "path", callers: str = "callers", callees: str = "callees") -> Column:
    """`kind: signature` and, where not empty, the module, callers and callees."""
    head = F.concat(F.coalesce(F.col(kind), F.lit("")), F.lit(": "), F.coalesce(F.col(signature), F.lit("")))
    return F.concat(head, _part("module", F.col(path)), _part("callers", F.col(callers)), _part("callees", F.col(callees)))


def embed_text() -> Column:
    """The stored text as it is, or else the node's."""
    return F.coalesce(F.col("embed_text"), node_text())


def estimated_tokens(text: Column) -> Column:
    return (F.floor(F.octet_length(text) / 4) + 4).cast("long")


def padded_seq(seq: Column) -> Column:
    out = F.lit(MAX_SEQ)
    for s in sorted(ROWS_OF_SEQ, reverse=True):
        out = F.when(seq <= s, s).otherwise(out)
    return out


def rows_of_seq(seq: Column) -> Column:
    out = F.lit(None).cast("int")
    for s, rows in ROWS_OF_SEQ.items():
        out = F.when(seq == s, rows).otherwise(out)
    return out


def padded_rows(batch: Column, seq: Column) -> Column:
    """The next power of two, at most the shape's rows; a larger batch keeps its own size."""
    cap = rows_of_seq(seq)
    power = F.lit(1)
    for k in range(1, 8):
        power = F.when(batch > (1 << k - 1), 1 << k).otherwise(power)
    return F.when(batch >= cap, batch).otherwise(F.least(power, cap))


def search_terms(query: Column) -> Column:
    """The longest distinct words of at least four bytes, longest first, ties by the word; at most three."""
    words = F.filter(F.split(query, r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= FTS_MIN_BYTES)
    ranked = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.octet_length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda x: x["w"]), 1, FTS_TERMS)


def match_expression(terms: Column) -> Column:
    """The terms as a full-text query: quoted, any of them."""
    return F.array_join(F.transform(terms, lambda w: F.concat(F.lit('"'), F.regexp_replace(w, '"', '""'), F.lit('"'))), " OR ")


def with_prefix(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), text)
