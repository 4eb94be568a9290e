"""Sharding by longest-processing-time scheduling: groups of equal texts stay together, the largest first, each to the
least-loaded shard of a heap.

A group of at least 1/`grain` of a shard's share is an item of its own, so there are at most `shards * grain` of them.
The smaller groups, by falling size within hash buckets, are strung into bundles of about that size; these are items
as well. Thus the heap on the driver sees a bounded number of items however many groups there are, and the loads differ
by about one item. The rows never meet in one task: a slot is the start of a row's item plus its place within a salted
part of the item.

Defined results: a null text counts as empty (size 16, crc32 0) and is in the group of empty texts; a null or repeated
id is a row like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialise


def schedule(items: list[tuple[str, int, int]], shards: int) -> list[tuple[str, int, int]]:
    """LPT: (name, bytes, rows) -> (name, shard, first slot). Ties go by name and by the lower shard."""
    heap = [(0, s) for s in range(shards)]
    filled = [0] * shards
    out = []
    for name, size, rows in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out.append((name, s, filled[s]))
        filled[s] += rows
        heapq.heappush(heap, (load + size, s))
    return out


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, grain: int = 1000) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law of near-equal bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.unhex(F.md5(text.cast("binary"))).alias("key"),
        ),
        "sizes",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total, n_rows, n_groups = groups.agg(F.sum("bytes"), F.sum("rows"), F.count(F.lit(1))).first()
    least = max(1, (total or 0) // (shards * grain))
    buckets = min(65536, max(64, (n_groups or 0) // 200_000))
    small = Window.partitionBy("bucket").orderBy(F.desc("bytes"), "key")
    bundle = F.floor((F.sum("bytes").over(small) - F.col("bytes")) / F.lit(least))
    named = groups.withColumn("bucket", F.when(F.col("bytes") < least, F.pmod(F.xxhash64("key"), F.lit(buckets))))
    placed = materialise(
        named.filter("bucket IS NULL")
        .select("key", "bytes", "rows", F.concat(F.lit("g"), F.hex("key")).alias("item"))
        .unionByName(named.filter("bucket IS NOT NULL").select("key", "bytes", "rows", F.concat_ws("-", F.lit("b"), "bucket", bundle.cast("string")).alias("item"))),
        "items",
    )
    items = [tuple(r) for r in placed.groupBy("item").agg(F.sum("bytes"), F.sum("rows")).collect()]  # at most shards * grain + total / least + buckets
    part_rows = max(1000, (n_rows or 0) // 10_000)
    parts = {name: -(-count // part_rows) for name, _, count in items}
    plan = schedule(items, shards)
    at = spark.createDataFrame([(name, s, parts[name]) for name, s, _ in plan], "item string, shard int, parts int")
    salted = (
        join_hot(rows, placed.select("key", "item", "rows"), ["key"], "rows")
        .drop("rows")
        .join(F.broadcast(at), "item")
        .withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.col("parts")).cast("int"))
    )
    split = {}  # of items over part_rows, at most 10,000 parts and one for each
    if any(p > 1 for p in parts.values()):
        for name, part, count in salted.filter("parts > 1").groupBy("item", "part").count().collect():
            split[name, part] = count
    starts = []
    for name, _, first in plan:
        for part in range(parts[name]):
            starts.append((name, part, first))
            first += split.get((name, part), 0)
    offsets = spark.createDataFrame(starts, "item string, part int, first long")
    place = F.row_number().over(Window.partitionBy("item", "part").orderBy("id"))
    return salted.join(F.broadcast(offsets), ["item", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + place - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
