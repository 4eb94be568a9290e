import re

import xxhash

from vecloom.llm import simhash as S


def fingerprint(text, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius=4):
    """For each value the least value reachable."""
    values = sorted(set(values))
    of = {v: v for v in values}

    def find(v):
        while of[v] != v:
            v = of[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_near_duplicates(odd, none):
    df, rows = odd
    fp = {t: fingerprint(t) for _, t in rows}
    of = groups(fp.values())
    least = {}
    for i, t in rows:
        if i is not None:
            least[of[fp[t]]] = min(i, least.get(of[fp[t]], i))
    want = sorted((str(i), fp[t], least.get(of[fp[t]])) for i, t in rows)
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(df).collect()) == want
    assert S.near_duplicates(none).count() == 0


def test_links_connect_all_that_are_near(spark):
    import random

    rng = random.Random(5)
    values = [0, (1 << 64) - 1]
    for _ in range(40):
        base = rng.getrandbits(64)
        values += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(rng.randint(0, 30))]
    values = sorted(set(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.links(df).collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    of = {v: v for v in values}

    def find(v):
        while of[v] != v:
            v = of[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == groups(values)


def test_a_dense_group_is_not_written_out(spark):
    import random

    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(2000)} | {rng.getrandbits(64) for _ in range(3000)}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    pairs = S.links(df).cache()
    assert pairs.count() < 200 * len(values)  # of 2,081 variants each
    dense = {v for v in values if (v ^ base).bit_count() <= 3}
    of = S.components(pairs).collect()
    assert len({r.component for r in of if r.node & (1 << 64) - 1 in dense}) == 1 and {r.node & (1 << 64) - 1 for r in of} >= dense


def test_collisions_of_several_variants_are_gone_through_again(spark, monkeypatch):
    import random

    rng = random.Random(7)
    bases = [rng.getrandbits(64) for _ in range(300)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), 4 * j)) for b in bases for j in (0, 1)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    monkeypatch.setattr(S, "SPARE_BITS", 0)  # each variant collides with another or two
    of = {r.node & (1 << 64) - 1: r.component for r in S.components(S.links(df)).collect()}
    want = groups(values)
    assert len(set(of.values())) == len({want[v] for v in of}) and set(of) == {v for v in values if list(want.values()).count(want[v]) > 1}


def test_keep_one(odd):
    df, rows = odd
    wide = df.selectExpr("doc_id", "text", "'a' AS fp", "1 AS row")
    kept = S.keep_one(wide).collect()
    of = groups([fingerprint(t) for _, t in rows])
    assert sorted(of[fingerprint(r.text)] for r in kept) == sorted(set(of.values()))
    least = {}
    for i, t in rows:
        g = of[fingerprint(t)]
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert {(of[fingerprint(r.text)], r.doc_id) for r in kept} == {(g, None if n else i) for g, (n, i) in least.items()}


def test_all_rows_equal(spark):
    df = spark.createDataFrame([(7, "same words here now")] * 5, "doc_id long, text string")
    assert [tuple(r) for r in S.keep_one(df).collect()] == [(7, "same words here now")]


def test_clashing_names_and_equal_rows(spark):
    text = "some words that are the same in all of these rows"
    rows = [(1, text, 5, True, 2), (1, text, 6, False, 1), (2, text, 7, True, 0), (3, "quite another line of words, with nothing in common", 8, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key long, __HIT boolean, other long")
    got = {tuple(r) for n in (1, 4) for r in S.keep_one(docs.repartition(n)).collect()}
    assert len(got) == 2 and {r[0] for r in got} == {1, 3} and got <= set(rows)


def test_a_used_worker_forgets_other_stages():
    import numpy as np

    from vecloom.llm import bpe, common

    data = np.frombuffer(b"one two", np.uint8)
    first = common.hash_spans(data, np.array([0, 4]), np.array([3, 7]))
    bpe._codecs["held"] = None
    common.forget()
    assert not common._powers and not bpe._codecs
    assert (common.hash_spans(data, np.array([0, 4]), np.array([3, 7])) == first).all()
