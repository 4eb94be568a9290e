import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import hashing
from vecloom.functions import text as T
from vecloom.functions import vectors as V


@pytest.mark.parametrize(
    "text, digest",
    [
        ("", "6c62272e07bb014262b821756295c58d"),
        ("a", "d228cb696f1a8caf78912b704e4a8964"),
        ("foobar", "343e1662793c64bf6f0d3597ba446f18"),
        ("alpha", "32833fc0db83d94f7081448bc656696b"),
        ("alphb", "32833fc0dc83d94f7081448bc6566aa6"),
        ("alpha ", "b345c8b7663c64bf6f0f57fd0c538f49"),
        ("chunk 1 body", "14ee07f7ca65bcfd47f8d60c8056945f"),
        ("é", "088093bf9eab1be95aa0733054c70821"),
    ],
)
def test_fnv_vectors(text, digest):
    assert hashing.fnv1a_128(text.encode()) == digest


def test_node_text_leaves_out_empty_parts(spark):
    rows = [(1, "function", "f(x)", "src/a.rs", "g, h", None), (2, None, None, "", "", None), (3, "class", "C", None, None, "i")]
    df = spark.createDataFrame(rows, "id long, kind string, signature string, path string, callers string, callees string")
    got = {r.id: r.t for r in df.select("id", T.node_text().alias("t")).collect()}
    assert got == {1: "function: f(x) | module: src/a.rs | callers: g, h", 2: ": ", 3: "class: C | callees: i"}


def test_terms_are_longest_first_and_distinct(spark):
    one = spark.range(1).select(T.search_terms(F.lit("foo parse_node parse_node tree trie été! abcdefgh")).alias("t"), T.match_expression(T.search_terms(F.lit("parse tree"))).alias("m"), T.search_terms(F.lit("a b")).alias("e")).first()
    assert one.t == ["parse_node", "abcdefgh", "été"]  # five bytes
    assert one.m == '"parse" OR "tree"' and one.e == []


def test_shapes(spark):
    seqs = {1: 32, 32: 32, 33: 64, 200: 256, 4096: 512}
    df = spark.createDataFrame(list(seqs.items()), "n int, want int")
    assert all(r.got == r.want for r in df.select("want", T.padded_seq(F.col("n")).alias("got")).collect())
    cases = [(128, 32, 128), (16, 256, 16), (3, 512, 4), (100, 32, 128), (65, 32, 128), (33, 32, 64), (1, 128, 1), (200, 512, 200)]
    df = spark.createDataFrame(cases, "n int, seq int, want int")
    assert all(r.got == r.want for r in df.select("want", T.padded_rows(F.col("n"), F.col("seq")).alias("got")).collect())


def test_estimates_are_of_bytes(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("éé",), ("abcdefg",)], "t string")
    assert [r.n for r in df.select(T.estimated_tokens(F.col("t")).alias("n")).collect()] == [4, 5, 5, 5]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [[round(x, 6) for x in r.n] for r in df.select(V.normalise(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    hidden = np.arange(12, dtype=float).reshape(1, 3, 4)
    assert V.pooled(hidden, np.array([[1, 1, 0]]), "cls")[0].tolist() == [0, 1, 2, 3]
    assert V.pooled(hidden, np.array([[1, 1, 0]]), "mean")[0].tolist() == [2, 3, 4, 5]
    assert V.pooled(hidden, np.array([[0, 0, 0]]), "mean")[0].tolist() == [0, 0, 0, 0]
    long = b"x" * 300
    assert spark.range(1).select(V.base64(F.lit(long)).alias("b")).first().b == base64.b64encode(long).decode()


@given(st.lists(st.floats(width=32, allow_nan=False), max_size=20), st.binary(max_size=3))
def test_packing_round_trip(values, rest):
    assert V.unpacked(V.packed(np.array(values, np.float32)) + rest).tolist() == np.array(values, np.float32).tolist()


def test_md5_is_a_hash_function(spark):
    assert spark.range(1).select(hashing.md5(F.lit("a")).alias("h")).first().h == hashlib.md5(b"a").hexdigest()


def test_hashes_of_many_at_once():
    import random

    import numpy as np

    from vecloom.functions import hashing as H

    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 60, 300]))) for _ in range(200)]
    cut = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    high, low = H.fnv1a_128_all(np.frombuffer(b"".join(texts), np.uint8), cut[:-1], cut[1:])
    assert [f"{h:016x}{x:016x}" for h, x in zip(high.tolist(), low.tolist())] == [H.fnv1a_128(t) for t in texts]
    assert H.fnv1a_128(b"") == "6c62272e07bb014262b821756295c58d"
