import zlib
from collections import Counter

from vecloom.llm.sharding import assign, schedule


def test_rows_sizes_and_slots(odd):
    df, rows = odd
    got = assign(df, 5).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    of = {}
    for r in got:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(v) == 1 for v in of.values())


def test_loads_are_even(spark):
    df = spark.createDataFrame([(i, "ab" * (1 + i * 7 % 90) + str(i)) for i in range(3000)], "doc_id long, text string")
    loads = Counter()
    for r in assign(df, 8).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.01 * max(loads.values())


def test_a_hot_group_is_cut_in_parts(spark, monkeypatch):
    df = spark.range(250_000).selectExpr("id AS doc_id", "'same' AS text", "1 AS shard", "2 AS size").unionByName(spark.createDataFrame([(-1, "other", 1, 2)], "doc_id long, text string, shard int, size int"))
    got = assign(df, 2)
    assert got.filter("shard = 0").count() + got.filter("shard = 1").count() == 250_001
    assert got.groupBy("shard").agg({"slot": "max"}).join(got.groupBy("shard").count(), "shard").filter("`max(slot)` + 1 <> count").count() == 0
    assert got.select("shard", "slot").distinct().count() == 250_001


def test_schedule_is_longest_first():
    plan = schedule([("a", 5, 1), ("b", 4, 2), ("c", 3, 1), ("d", 3, 1), ("e", 3, 1)], 2)
    load = Counter()
    for name, shard, _ in plan:
        load[shard] += {"a": 5, "b": 4, "c": 3, "d": 3, "e": 3}[name]
    assert sorted(load.values()) == [8, 10] and [p[0] for p in plan][:2] == ["a", "b"]


def test_empty(none):
    assert assign(none, 3).count() == 0
