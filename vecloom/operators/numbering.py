"""Consecutive numbers over an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are numbered in one task, about, unless that would be more than MOST_RANGES ranges.
RANGE_ROWS = 1000
MOST_RANGES = 1 << 15


def numbered(rows: DataFrame, lead: list[str], order: list[Column], within: list[str] | None = None, id_col: str = "id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds `place`, from 0 among rows equal in `within`: by `order` over the columns `lead`, then by id.

    Rows of equal `lead` are cut in ranges of ids; the counts of the ranges, summed up, give the number each begins with.
    Null ids are last.
    """
    within = within or []
    keyed = rows.withColumn("__lead", F.to_json(F.struct(*lead)))
    groups = keyed.groupBy("__lead").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("__low"), F.max(id_col).alias("high"))
    most = F.greatest(F.lit(range_rows), F.ceil(F.col("every") / MOST_RANGES))
    low = F.col("__low").cast("double")  # the difference of two ids may exceed a long
    step = (F.col("high").cast("double") - low + 1) / F.ceil(F.col("n") / most)
    # only leads of more rows than a range are cut: MOST_RANGES at most
    cut = groups.crossJoin(F.broadcast(groups.agg(F.sum("n").alias("every")))).filter(F.col("n") > most).select("__lead", "__low", F.greatest(F.lit(1.0), step).alias("__step"))
    ranged = keyed.join(F.broadcast(cut), "__lead", "left")
    place = F.floor((F.col(id_col).cast("double") - low) / F.col("__step")).cast("long")
    last = F.when(F.col(id_col).isNull() & F.col("__step").isNotNull(), (1 << 63) - 1).otherwise(0)
    ranged = ranged.withColumn("__range", F.coalesce(place, last)).drop("__low", "__step")
    counts = ranged.groupBy("__lead", "__range", *(F.col(c).alias(f"__{c}") for c in lead)).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("__lead", "__range", "n", *(F.col(f"__{c}").alias(c) for c in lead))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order, "__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = counts.select("__lead", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__lead", "__range").orderBy(F.asc_nulls_last(id_col))) - 1
    placed = ranged.withColumn("__inside", inside).join(firsts, ["__lead", "__range"])
    return placed.withColumn("place", F.col("__first") + F.col("__inside")).drop("__lead", "__range", "__inside", "__first")
