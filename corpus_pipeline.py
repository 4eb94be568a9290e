"""From raw documents to token ids: toxic documents go, repeated lines go, one of each group of near-duplicates stays,
documents with benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; what it returns is written as
Parquet and read again as the next one's docs. Only then are the intermediate tables of a stage deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import bpe, decontamination, lines, simhash, toxicity
from vecloom.llm.common import made, materialise, release, table, tune
from vecloom.llm.queries import TOXIC_FROM, tokenizer_path

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_spans: list[tuple[int, int]] = []


def _stage(run: Stage) -> Stage:
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        while _spans:
            release(*_spans.pop(), used_by=docs)
        first = made()
        out = run(spark, docs, sf_dir)
        _spans.append((first, made()))
        return out

    staged.__name__, staged.__doc__ = run.__name__, run.__doc__
    return staged


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit. The model learns from labelled documents, but for the held-out fourth."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.keep(docs, *toxicity.fit(docs, labels), TOXIC_FROM)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur before, be it slightly changed; n_chars is the new length."""
    return lines.deduplicate(docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by fingerprints of five-word shingles."""
    return simhash.keep_one(docs, SHINGLE)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text decoded from them."""
    coded = bpe.encode(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: Training, edit distances and byte-pair merges are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
