from vecloom.llm import decontamination as D

ITEM = "Tom Miller has 12 apples and buys 5 kg more in Boston. Later Tom Miller sells 12 apples for 3,50 dollars each to Jane, who lives in Boston too."
SAME = ITEM.replace("Tom Miller", "Ann Lee").replace("12", "40").replace("5 kg", "7 kg").replace("Boston", "Denver").replace("3,50", "9.25").replace("Jane", "Bob")
TORN = SAME.replace("40", "41", 1)
OTHER = "an entirely different text about rivers and stones without any question in it at all"


def judged(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.n_items, r.item_id, r.changed) for r in D.judge(d, b).collect()}


def test_templates(spark):
    docs = [(1, ITEM), (2, f"{OTHER}. {SAME} {OTHER}"), (3, f"{OTHER}. {TORN}"), (4, OTHER), (5, None), (6, ""), (7, " ".join(ITEM.split()[:12])), (8, ITEM.upper()), (9, "so short a one")]
    got = judged(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "x"), (14, "so short a one"), (15, ITEM)])
    assert got[1] == (2, 10, False) and got[2] == (2, 10, True)
    assert got[9] == (1, 14, False)
    assert all(got[i] == (0, None, None) for i in (3, 4, 5, 6, 7))


def test_items_of_slots_mostly(spark):
    items = [(1, "Convert 5 km to miles"), (2, "Solve 3 x + 5 = 20"), (3, "3 4 5 6 7 8 9"), (4, "Why so"), (5, "12")]
    docs = [(i, f"{OTHER}. {t}. {OTHER}") for i, t in items] + [(10 + i, t) for i, t in items]
    docs += [(20, f"{OTHER}. Convert 8 km to miles."), (21, "Convert 8 km of miles"), (22, "3 4 5 6 7 8 9 1"), (23, "1 2 3 4 5 6 7"), (24, "Why so late"), (25, "13")]
    got = {i: v[1] for i, v in judged(spark, docs, items).items()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5)} == {1: 1, 2: 2, 3: 3, 4: None, 5: None}
    assert {i: got[10 + i] for i in (1, 2, 3, 4, 5)} == {i: i for i in (1, 2, 3, 4, 5)}
    assert {i: got[i] for i in range(20, 26)} == {20: 1, 21: None, 22: 3, 23: None, 24: None, 25: None}


def test_names_at_the_start_of_sentences_and_numbers_of_several_words(spark):
    items = [(1, "Betty saves 10 dollars. Betty has a jar for the coins she finds. Betty buys 3 pens with the coins and gives a pen to her aunt. At home the aunt puts the pen in a drawer and writes a long letter of thanks in the evening."), (2, "the pump fills a tank of thirty litres in 1/2 hour while a leak drains it at the bottom")]
    other = items[0][1].replace("Betty", "Maria").replace("10", "25").replace("3 pens", "8 pens")
    docs = [(1, other), (2, f"{OTHER}, {other}"), (3, other.replace("Maria buys", "Carla buys")), (4, other.replace("a jar for", "a big jar for")), (5, other.replace("the coins and gives", "coins and gives"))]
    docs += [(6, "the pump fills a tank of twenty five litres in 3 hours while a leak drains it at the bottom"), (7, f"he read: {items[0][1]}")]
    got = {i: v[1] for i, v in judged(spark, docs, items).items()}
    assert got == {1: 1, 2: 1, 3: None, 4: 1, 5: 1, 6: 2, 7: 1}


def brute(text, item, share=0.8):
    """The same judgement by trying every diagonal, over tokens from template()."""
    import pyarrow as pa

    code, value, row = D.template(*D.text_bytes(pa.array([text, item])))
    t, i = [(code[row == k].tolist(), value[row == k].tolist()) for k in (0, 1)]
    n = len(i[0]) - 4
    use = [a for a in range(n) if sum(c > 3 for c in i[0][a : a + 5]) >= 3]
    for shift in range(-len(i[0]), len(t[0])):
        at = [a for a in use if 0 <= a + shift and a + shift + 5 <= len(t[0]) and t[0][a + shift : a + shift + 5] == i[0][a : a + 5]]
        pairs = {(i[1][a + j], t[1][a + j + shift]) for a in at for j in range(5) if i[0][a + j] <= 3}
        if use and len(at) >= share * len(use) - 1e-9 and len({p for p, _ in pairs}) == len(pairs):
            return True
    return False


def test_against_brute_force_on_other_parameters(spark):
    import random

    rng = random.Random(9)
    verbs, things, places = ("buys sells finds counts packs paints lends".split(), "apples shirts nails stamps bottles tickets bricks".split(), "market harbour school garden station".split())
    names = "Ana Ben Carl Dora Emil Fay Gus Hana Ivo Jan".split()

    def question(v, th, pl, name, other, a, b):
        return f"{name} {v} {a} {th} at the {pl} on a rainy morning. Then {other} takes {b} of these {th} away in a wooden cart. How many {th} are left for {name} when the {pl} closes?"

    def values():
        return (*rng.sample(names, 2), rng.randint(2, 99), rng.randint(100, 999))

    forms = [(rng.choice(verbs), rng.choice(things), rng.choice(places)) for _ in range(25)]
    items = [(k, question(*f, *values())) for k, f in enumerate(forms)]
    docs = [(k, f"{OTHER}. {question(*rng.choice(forms), *values())} {OTHER}") for k in range(60)]
    docs += [(100 + k, question(rng.choice(verbs), rng.choice(things), rng.choice(places), *values()).replace("Then", "Now") + " " + rng.choice(places)) for k in range(30)]
    docs += [(200 + k, t.replace("are left for", f"are left for {rng.choice(names)} and")) for k, (_, t) in enumerate(items)]
    want = {i: sum(brute(t, item) for _, item in items) for i, t in docs}
    got = {i: v[0] for i, v in judged(spark, docs, items).items()}
    assert all(got[i] >= want[i] for i, _ in docs) and sum(want.values()) >= 60
    assert all(want[i] and got[i] for i in range(60))  # whatever has other parameters only is caught
    assert sum(got[i] != want[i] for i, _ in docs) <= 30  # chains of near diagonals add the inserted words


def test_against_brute_force_on_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    flat = lambda t: " ".join((t or "").split())
    known = [flat(r.text) for r in items.collect()]
    want = {r.doc_id for r in docs.collect() if any(k in flat(r.text) for k in known)}
    judged = D.judge(docs, items)
    assert {r.doc_id for r in judged.filter("n_items > 0").collect()} == want and want
    assert {r.doc_id for r in D.remove(docs, items).collect()} == {r.doc_id for r in docs.collect()} - want


def test_odd_rows_and_empty_tables(spark, odd, none):
    df, rows = odd
    items = spark.createDataFrame([(1, next(t for i, t in rows if i == 10))], "item_id long, text string")
    wide = df.selectExpr("doc_id", "text", "1 AS row", "2 AS w", "3 AS item_id")
    left = D.remove(wide, items)
    hit = [t for _, t in rows if t and items.first().text in t]
    gone = len(rows) - left.count()
    near = [t for i, t in rows if i in (70, 75)]  # with one word changed
    assert left.columns == wide.columns and len(hit) <= gone <= len(hit) + len(near)
    assert D.remove(none, items).count() == 0
    assert D.remove(df, items.limit(0)).count() == len(rows)


def test_slots_are_typed():
    import pyarrow as pa

    code, value, row = D.template(*D.text_bytes(pa.array(["Buy 5kg, or two. Paul Smith paid 1,200.50 Euro", None, "Été à Paris"])))
    kinds = [int(c) if c <= 3 else "w" for c in code]
    assert kinds == [3, 1, 2, "w", 1, 3, "w", 1, 2, 3, "w", 3]
    assert row.tolist()[-3:] == [2, 2, 2] and len(value) == len(code)
