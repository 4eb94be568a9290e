import random

import pytest

WORDS = "the of and to in river stone lantern orchard copper window garden silver maple anchor bridge candle ribbon meadow harbor".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 9)) if rng.random() < 0.2 else "") for _ in range(n))


def odd_rows():
    """Nulls, empties, blanks, long texts, copies, near copies, repeated rows and one id twice."""
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One TWO three"), (None, "no id at all, but words enough to be a line of its own"), (None, None)]
    base = [sentence(rng, 40) for _ in range(6)]
    for i, b in enumerate(base):
        rows += [(10 + i, b), (30 + i, b), (50 + i, b + " tail"), (70 + i, b.replace("the", "a", 1) + "\n" + base[(i + 1) % 6])]
    rows += [(90, base[0]), (90, base[0]), (91, base[0]), (91, base[1]), (92, "x" * 5000 + " y"), (93, "\n".join(sentence(rng, 12) for _ in range(400)))]
    rows += [(94, "ÉTÉ à Noël — naïve 😀 <|endoftext|>   　 it's 12,5 km's\r\n\r\n  end  "), (95, sentence(rng, 3000))]
    rows += [(100 + i, sentence(rng, rng.randint(0, 60))) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df, rows


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
