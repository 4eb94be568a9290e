"""Lines of JSON: texts in, vectors out, in the order of the input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import packed
from ..operators.encoder import worker_encoder
from .descriptor import Descriptor

BATCH = 32


def string_field(line: str | None, key: str) -> str | None:
    """A top-level string field of one line of JSON, None where it is missing or no string."""
    import json

    try:
        value = json.loads(line or "").get(key)
    except (ValueError, AttributeError):
        return None
    return value if isinstance(value, str) else None


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """place, id, text. Blank lines are passed over; a line without both fields fails the job."""
    return parsed_lines(spark.read.text(path))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """The same of lines (value)."""
    lines = lines.filter(F.trim("value") != "").withColumn("place", F.monotonically_increasing_id())
    parsed = lines.select("place", F.from_json("value", "id string, text string").alias("x"), "value")
    whole = F.col("x.id").isNotNull() & F.col("x.text").isNotNull()
    checked = F.when(whole, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("a line lacks id or text: "), F.substring("value", 1, 80))).cast("struct<id:string,text:string>"))
    return parsed.select("place", checked.alias("x")).select("place", "x.id", "x.text")


def embed_lines(texts: DataFrame, d: Descriptor, folder: str | None = None, queries: bool = False) -> DataFrame:
    """place, id, dim, b64 (the vector's 32-bit floats). Documents are embedded in batches of like length, queries alone with their prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        encoder = worker_encoder(folder, d)
        for pdf in frames:
            if queries:
                out = [encoder.embed_query(t) for t in pdf["text"]]
            else:
                pdf = pdf.sort_values("text", key=lambda s: s.str.encode("utf-8").str.len(), kind="stable")
                out = [v for i in range(0, len(pdf), BATCH) for v in encoder.embed_documents(pdf["text"][i : i + BATCH].tolist())]
            yield pd.DataFrame({"place": pdf["place"], "id": pdf["id"], "dim": encoder.dim, "b64": [base64.b64encode(packed(v)).decode() for v in out]})

    return texts.select("place", "id", "text").mapInPandas(run, "place long, id string, dim int, b64 string")


def write_lines(vectors: DataFrame, path: str) -> None:
    """One object a line, by place: the files in the order of their names hold the input's order."""
    vectors.orderBy("place").select(F.to_json(F.struct("id", "dim", "b64")).alias("value")).write.mode("overwrite").text(path)
