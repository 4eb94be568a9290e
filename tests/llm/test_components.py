import random

from vecloom.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (1, 0), (0, 1)]
    of = {}

    def find(v):
        of.setdefault(v, v)
        while of[v] != v:
            v = of[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
