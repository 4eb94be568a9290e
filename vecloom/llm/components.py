"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join back, so a hub with any number of links is no
task of its own; nothing is collected. After each round the links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes with a link to another; component: the least node reachable."""
    ends = links.filter(f"`{a}` <> `{b}`")
    now = materialise(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    was = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        was = state
        now = materialise(_small(_large(now).distinct()).distinct(), "links")
