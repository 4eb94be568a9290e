from itertools import combinations

import pytest
from pyspark.sql import functions as F

from vecloom.llm import url_rules as U
from vecloom.llm.queries import URL_RULES

URLS = {
    1: "https://A.Example.ORG/es/1",
    2: "http://example.org/en/185?x=1",
    3: "http://sub.example.org/en/2",
    4: "http://notexample.org",
    5: "http://x.com/fr/#a",
    6: "http://x.com?/de/",
    7: "no scheme at all",
    8: None,
    9: "ftp://x.net/de/://y.org/",
    10: "http://x.com/de/1",
    11: "http://org/",
    12: "://",
    13: "http://x.org:80/a",
}
WANT = {
    1: ("a.example.org", "/es/1", "example.org/es/", "block"),
    2: ("example.org", "/en/185", "example.org/en/1", "block"),
    3: ("sub.example.org", "/en/2", "org/", "allow"),
    4: ("notexample.org", "", None, "allow"),
    5: ("x.com", "/fr/", "com/fr/", "allow"),
    6: ("x.com", "", None, "allow"),
    7: ("", "", None, "allow"),
    8: ("", "", None, "allow"),
    9: ("x.net", "/de/://y.org/", None, "allow"),
    10: ("x.com", "/de/1", "com/de/", "block"),
    11: ("org", "/", "org/", "allow"),
    12: ("", "", None, "allow"),
    13: ("x.org:80", "/a", None, "allow"),
}


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, u) for i, u in URLS.items()], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, labels, URL_RULES).collect()}
    assert got == WANT


def heads_of(rows):
    """For each item the first of those that are in exactly the same rows."""
    of = {}
    for n, (items, _) in enumerate(rows):
        for i in items:
            of.setdefault(i, set()).add(n)
    return {i: min(j for j in of if of[j] == of[i]) for i in of}


def brute(rows, least, confidence):
    """Every item set within a blocked URL, counted over all."""
    out = {}
    head = heads_of(rows)
    rows = [({head[i] for i in items}, bad) for items, bad in rows]
    seen = {s for items, bad in rows if bad for k in range(1, len(items) + 1) for s in combinations(sorted(items), k)}
    for s in seen:
        n = sum(set(s) <= set(i) for i, _ in rows)
        bad = sum(set(s) <= set(i) and b for i, b in rows)
        if bad >= least and bad / n >= confidence:
            out[s] = bad / n
    return out


@pytest.fixture(scope="module")
def mined(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(240):
        host, lang, key = rng.choice(["spam", "good", "blog"]), rng.choice(["en", "de"]), rng.choice(["ref", "id"])
        bad = (host == "spam" and lang == "de") or (key == "ref" and host == "blog" and rng.random() < 0.8)
        rows.append((i, f"http://{host}.example.com/{lang}/{rng.randint(1, 99)}?{key}=1", bad if i % 4 else None))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    items = df.select("page_id", "url", "blocked", U.items(F.col("url"), U.host(F.col("url")), U.path(F.col("url"))).alias("items"))
    return df, items, U.mine(items.select("items", "blocked"), min_support=0.01, min_count=5, min_confidence=0.6)


def test_mined_rules_are_all_rules(mined):
    _, items, (rules, _) = mined
    rows = [(r["items"], r.blocked) for r in items.filter("blocked IS NOT NULL").collect()]
    got = {tuple(r.antecedent): round(r.confidence, 9) for r in rules.collect()}
    assert got == {k: round(v, 9) for k, v in brute(rows, 5, 0.6).items()} and got


def test_match_finds_the_best_rule(mined):
    _, items, (rules, twins) = mined
    known = rules.collect()
    head = {r.item: r["head"] for r in twins.collect()}
    got = {tuple(r["items"]): tuple(r.mined) for r in U.match(items, rules, twins).collect()}
    for r in items.collect():
        fit = [k for k in known if set(k.antecedent) <= {head.get(i) for i in r["items"]}]
        best = max(fit, key=lambda k: (k.confidence, k.support, " ".join(k.antecedent)), default=None)
        assert got.get(tuple(r["items"])) == (tuple(best.antecedent) if best else None)


def mined_from(spark, rows, **least):
    rules, _ = U.mine(spark.createDataFrame(rows, "items array<string>, blocked boolean"), **least)
    return {tuple(r.antecedent): (round(r.support, 9), round(r.confidence, 9)) for r in rules.collect()}


def test_counts_are_of_rows(spark):
    # a and b five times blocked each, together once, among many rows without frequent items
    rows = [(["a"], True)] * 4 + [(["b"], True)] * 4 + [(["a", "b"], True)] + [([f"x{i}"], False) for i in range(991)]
    assert mined_from(spark, rows, min_support=0.0, min_count=5) == {("a",): (0.005, 1.0), ("b",): (0.005, 1.0)}
    # met exactly five times out of 147
    rows = [(["a"], True)] * 5 + [(["b"], False)] * 142
    assert mined_from(spark, rows, min_support=0.0, min_count=5) == {("a",): (round(5 / 147, 9), 1.0)}


def test_items_that_always_come_together_are_one(spark):
    keys = [f"q:{i:02d}" for i in range(25)]
    rows = [(keys, True)] * 6 + [(["q:x"], False)] * 6
    assert mined_from(spark, rows) == {("q:00",): (0.5, 1.0)}
    rules, twins = U.mine(spark.createDataFrame(rows, "items array<string>, blocked boolean"))
    urls = spark.createDataFrame([(["q:07", "z"],), (["q:x"],)], "items array<string>")
    assert [tuple(r["items"]) for r in U.match(urls, rules, twins).collect()] == [("q:07", "z")]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, True)], "page_id long, blocked boolean")
    assert U.judge(pages, labels, URL_RULES).count() == 0
