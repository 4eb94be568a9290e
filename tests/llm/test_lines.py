import re

import numpy as np
import pyarrow as pa

from vecloom.llm import common as C
from vecloom.llm import lines as L


OWN = "[\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3040-\ufeff\uff10-\U0010ffff]"
WORD = re.compile(f"{OWN}|(?:(?!{OWN})[0a-z\u0080-\u1fff\u2080-\u2fff])+")


def words(line):
    return WORD.findall(re.sub("[0-9]", "0", line.lower()))


def keys(lines):
    """Of each line: its keys, SimHash and whether its SimHash counts."""
    data, off = C.text_bytes(pa.array(lines))
    starts, _ = L.split_lines(data, off)
    low, start, end, _, first = L.normalised(data, starts, off)
    key, line, sim, wide = L.keys_of(low, start, end, first[:-1], first[1:])
    out = [set() for _ in lines]
    for k, i in zip(key.tolist(), line.tolist(), strict=True):
        out[i].add(k)
    return list(zip(out, sim.tolist(), wide.tolist(), strict=True))


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, e in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
        p = q
    return p[-1]


def linked(a, b, x, y):
    """Whether lines a and b with keys() x and y link."""
    if not x[0] & y[0] or x[2] and y[2] and (x[1] ^ y[1]).bit_count() > L.RADIUS:
        return False
    longer = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 0.2 * longer + 1e-9 and L.edit_distance(a, b) <= 0.2 * longer + 1e-9  # test_edit_distance compares it with levenshtein()


def brute(rows):
    place = lambda i: (i is None, i or 0)
    occ = {}
    for n, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            if w := words(line):
                occ.setdefault(" ".join(w), []).append((place(i), n, k))
    lines = sorted(occ)
    of_line = dict(zip(lines, keys(lines), strict=True))
    of = {k: k for k in lines}

    def find(k):
        while of[k] != k:
            k = of[k]
        return k

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if linked(a, b, of_line[a], of_line[b]):
                of[find(a)] = find(b)
    groups = {}
    for k in lines:
        groups.setdefault(find(k), []).extend(occ[k])
    return list(groups.values())


def test_one_occurrence_of_each_group_stays(odd, none):
    df, rows = odd
    rows = [(i, t) for i, t in rows if t is None or len(t) < 4000]
    df = df.sparkSession.createDataFrame([(i, t, "a", len(t or "")) for i, t in rows], "doc_id long, text string, block string, n_chars long").repartition(3)
    got = L.deduplicate(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    out = got.collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) and r.block == "a" for r in out)
    groups = brute(rows)
    # ties between rows of one id: which one keeps the line is open, so compare what is left by id
    left = sorted((str(r.doc_id), w) for r in out for w in map(" ".join, map(words, r.text.split("\n"))) if w)
    want = []
    for g in groups:
        first, n, k = min(g)
        want.append((str(rows[n][0]), " ".join(words(rows[n][1].split("\n")[k]))))
    assert left == sorted(want)
    assert L.deduplicate(none).count() == 0


def left_of(spark, lines):
    rows = list(enumerate(lines))
    groups = brute(rows)
    out = L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).filter("text <> ''").collect()
    assert sorted(r.doc_id for r in out) == sorted(min(g)[1] for g in groups)
    return len(out)


def vocabulary(rng, n):
    return ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def changed(rng, line, n, known):
    w = line.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(known)
    return " ".join(w)


def test_families_and_chains(spark):
    import random

    rng = random.Random(8)
    known = vocabulary(rng, 500)
    lines = []
    for size in (5, 12, 20, 40, 70):
        base = " ".join(rng.choice(known) for _ in range(size))
        lines += [base] + [changed(rng, base, 1, known) for _ in range(12)]
        for _ in range(12):  # a chain, whose ends are no longer alike
            base = changed(rng, base, max(1, size // 8), known)
            lines.append(base)
        lines += [" ".join(rng.choice(known) for _ in range(size)) for _ in range(5)]
    rng.shuffle(lines)
    assert left_of(spark, lines) < len(lines) - 60


def test_a_line_whose_partner_has_met_another_is_linked(spark):
    import random

    # y is near both x and torn, which come first, but torn is no edit of it; so y's first partner fails
    rng = random.Random(3)
    known = vocabulary(rng, 300)
    lines = []
    for _ in range(40):
        base = [rng.choice(known) for _ in range(40)]
        torn = base[:10] + base[30:] + base[10:30]
        lines += [" ".join(torn), changed(rng, " ".join(base), 2, known), " ".join(base)]
    assert left_of(spark, lines) == 80


def test_first_meetings():
    # by the SimHash: 0 - 1 and 1 - 2 are near, 0 - 2 not; 3 is alone, 4 and 5 are in another key
    bits = lambda n: sum(1 << k for k in range(n))
    sim = np.array([0, bits(16), bits(32), bits(64), 0, 1], np.uint64)
    x, y, paired = L.first_meetings(np.array([1, 1, 1, 1, 2, 2], np.uint64), sim, np.full(6, 100, np.int32), 0.8)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 1), (1, 2), (4, 5)] and paired.tolist() == [True, True, True, False, True, True]


def test_recall_against_edit_similarity_alone():
    import random

    rng = random.Random(5)
    known = vocabulary(rng, 3000)
    every = {}
    for size in (4, 8, 15, 16, 17, 25, 31, 33, 60, 64, 90, 200):
        for name, n in (("one", 1), ("tenth", max(1, size // 10))):
            a = [" ".join(rng.choice(known) for _ in range(size)) for _ in range(40)]
            for b, hits in (([changed(rng, x, n, known) for x in a], every.setdefault(name, [])), ([" ".join(x.split()[: size // 2] + x.split()[size // 2 + 1 :]) for x in a], every.setdefault("dropped", [])), ([" ".join(w[:-2] + "zz" if k == size // 2 else w for k, w in enumerate(x.split())) for x in a], every.setdefault("letters", []))):
                for s, t, k, j in zip(a, b, keys(a), keys(b), strict=True):
                    if s != t and L.similar(s, t, 0.8):
                        hits.append(linked(s, t, k, j))
    share = {k: sum(v) / len(v) for k, v in every.items()}
    assert min(len(v) for v in every.values()) > 300
    assert share["one"] > 0.99 and share["dropped"] > 0.99 and share["letters"] > 0.99 and share["tenth"] > 0.9, share


def test_short_lines_and_scripts_without_spaces(spark):
    lines = ["Introduction", "introductoin x", "Introductoin", "Introductio", "Yes", "yes!", "YES", "No", "Total due", "Total du", "今日は天気がとても良いですね。散歩に行きます", "今日は天気がとても良いですね。散歩に行くます", "", "---", "---", "สวัสดีครับ ผมชื่อสมชาย", "สวัสดีครับ ผมชื่อสมหาย"]
    out = {r.doc_id for r in L.deduplicate(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).filter("text <> ''").collect()}
    assert out == {0, 4, 7, 8, 10, 13, 14, 15}


def test_edit_distance():
    import random

    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 80)))
        b = "".join(c for c in a if rng.random() < 0.9) + "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
        d = levenshtein(a, b)
        assert L.edit_distance(a, b) == d == L.edit_distance(b, a)
        assert all((L.edit_distance(a, b, most) <= most) == (d <= most) for most in range(0, 40, 3))
    for _ in range(400):
        a = [rng.choice(["a", "bb", "abc", "b"]) for _ in range(rng.randint(0, 20))]
        b = [w for w in a if rng.random() < 0.8] + [rng.choice(["a", "c"]) for _ in range(rng.randint(0, 4))]
        assert L.edit_bound(" ".join(a), " ".join(b)) >= levenshtein(" ".join(a), " ".join(b))
        assert L.edit_bound(" ".join(a), " ".join(a)) == 0
