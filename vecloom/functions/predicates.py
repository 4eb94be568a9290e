"""Which nodes count: for embedding, for the two search spaces, for a phase, a shard or a range. Null logic is SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOC_KIND, STRUCTURAL_KINDS


def structural(kind: Column) -> Column:
    return kind.isin(*STRUCTURAL_KINDS)


def embeddable() -> Column:
    """Has something to embed: no structural node without own text, no prose without text."""
    kind, text = F.col("kind"), F.col("embed_text")
    return (~structural(kind) | text.isNotNull()) & ~((kind == DOC_KIND) & text.isNull())


def in_code_space() -> Column:
    kind = F.col("kind")
    return (kind != DOC_KIND) & (~structural(kind) | F.col("embed_text").isNotNull())


def in_doc_space() -> Column:
    return F.col("kind") == DOC_KIND


def in_space(space: str) -> Column:
    return {"code": in_code_space, "docs": in_doc_space}[space]()


def in_phase(phase: tuple[int, int] | None) -> Column:
    """phase: (1, t) for shell numbers from t on, (2, t) for those below, None for all; a null is in neither phase."""
    if phase is None:
        return F.lit(True)
    which, t = phase
    return F.col("shell_number") >= t if which == 1 else F.col("shell_number") < t


def in_shard(i: int, n: int, key: str = "id") -> Column:
    return F.pmod(F.col(key), F.lit(n)) == i


def in_rows(start: int, end: int, key: str = "id") -> Column:
    return (F.col(key) >= start) & (F.col(key) < end)


def in_tests(path: Column) -> Column:
    """Case does not count, and _ stands for any character."""
    return path.ilike("%_test.%") | path.ilike("%/testing/%") | path.ilike("test/%")


def hash_differs(have: Column, want: Column) -> Column:
    return have.isNull() | (have != want)


def decodable() -> Column:
    """Rows of nodes that can be worked with: those with an id and a kind."""
    return F.col("id").isNotNull() & F.col("kind").isNotNull()
