import numpy as np
from pyspark.sql import functions as F

from vecloom.operators import fts, knn


def vectors(spark, n=300, dim=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<float>")


def test_a_vector_finds_itself(spark):
    x, df = vectors(spark)
    asked = df.filter("node_id IN (7, 42)").select(F.col("node_id").alias("query_id"), "embedding")
    first = {r.query_id: r.node_id for r in knn.exact(asked, df, 3).filter("rank = 1").collect()}
    assert first == {7: 7, 42: 42}
    assert knn.one(x[42].tolist(), df, 1).first().node_id == 42


def test_exact_is_exact_in_turns(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    x, df = vectors(spark)
    asked = df.filter("node_id < 10").select(F.col("node_id").alias("query_id"), "embedding")
    got = {}
    for r in knn.exact(asked, df.repartition(3), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.node_id
    y = x.astype(np.float32).astype(float)
    for q in range(10):
        d = np.round(1 - y @ y[q], 6)
        assert [got[q][k] for k in range(1, 6)] == np.lexsort((np.arange(len(d)), d))[:5].tolist()


def test_inverted_file_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("node_id"), "embedding")
    asked = df.filter("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    index = knn.InvertedFile.fit(df, cells=32)
    exact = {(r.query_id, r.node_id) for r in knn.exact(asked, df, 10).collect()}
    found = {(r.query_id, r.node_id) for r in index.search(asked, index.assign(df), 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_merge_keeps_found_first(spark):
    a = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "node_id long, similarity double, rank int")
    b = spark.createDataFrame([(2, 0.7, 1), (5, 0.6, 2), (6, 0.5, 3)], "node_id long, similarity double, rank int")
    assert [r.node_id for r in knn.merge(a, b, 3).collect()] == [1, 2, 5]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "node_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert knn.exact(asked, empty, 3).count() == 0


def test_candidates_by_text(spark):
    nodes = spark.createDataFrame([(1, "fn parse_tree"), (2, "fn Parse_Tree parse_tree"), (3, "fn walk"), (4, None), (5, "fn a"), (6, "fn b"), (7, "fn c")], "id long, signature string")
    got = fts.candidates(nodes, "parse_tree of it").collect()
    assert [r.node_id for r in got] == [2, 1] and got[0].rank == 1
    assert fts.candidates(nodes, "a b").isEmpty()
    assert fts.candidates(nodes.limit(0), "parse_tree").isEmpty()


def test_ties_at_the_edge_go_by_node():
    rng = np.random.default_rng(1)
    for k in (1, 3, 7, 50):
        d, node = rng.integers(0, 4, (20, 40)).astype(float), np.argsort(rng.random((20, 40)), axis=1)
        got_d, got = knn._best(d, node, k)
        want = np.lexsort((node, d), axis=1)[:, :k]
        order = np.lexsort((got, got_d), axis=1)
        assert (np.take_along_axis(got, order, 1) == np.take_along_axis(node, want, 1)).all()


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<float>")
    queries = vectors.limit(25).withColumnRenamed("node_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.rank, r.node_id) for r in df.collect())
    index = knn.InvertedFile.fit(vectors, cells=4)
    whole, cells = rows(knn.exact(queries, vectors, 5)), rows(index.search(queries, index.assign(vectors), 5, 4))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "VECTOR_BLOCK", 11)
    assert rows(knn.exact(queries, vectors, 5)) == whole == cells == rows(index.search(queries, index.assign(vectors), 5, 4))
    none = queries.filter("false")
    assert knn.exact(none, vectors, 5).isEmpty() and index.search(none, index.assign(vectors), 5).isEmpty()
