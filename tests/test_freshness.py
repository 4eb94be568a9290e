import pytest

from vecloom.functions.hashing import fnv1a_128
from vecloom.operators.freshness import invalidate
from vecloom.operators.pending import candidates
from vecloom.schema import EMBEDDINGS, migrate

H = lambda t: fnv1a_128(t.encode())
NODE = "id long, kind string, embed_text string, shell_number int"


def tables(spark, nodes, vectors, log):
    n = spark.createDataFrame([(*x, None) for x in nodes], NODE)
    e = spark.createDataFrame([(i, "m", [1.0], h) for i, h in vectors], EMBEDDINGS)
    t = spark.createDataFrame([(i, 0) for i in log], "node_id long, deleted_at long")
    return n, e, t


def run(spark, nodes, vectors, log, **options):
    done = invalidate(*tables(spark, nodes, vectors, log), **options)
    report = {k: v for k, v in done.report.first().asDict().items() if v}
    return report, sorted(r.node_id for r in done.embeddings.collect()), sorted(r.node_id for r in done.tombstones.collect())


DOCS = [(i, "doc-chunk", f"chunk {i} body") for i in (1, 2, 3)]
FRESH = [(i, H(f"chunk {i} body")) for i in (1, 2, 3)]
EDITED = [DOCS[0], (2, "doc-chunk", "chunk 2 changed"), DOCS[2]]


def test_churn(spark):
    assert run(spark, EDITED, FRESH, [1, 2, 3, 2]) == ({"stale": 1, "unchanged": 2, "removed_any": True}, [1, 3], [])


def test_orphans(spark):
    assert run(spark, DOCS[:1], [FRESH[0], (99, "x")], []) == ({"orphaned": 1, "removed_any": True}, [1], [])


def test_defer_keeps_vector_and_entry(spark):
    assert run(spark, [(1, "doc-chunk", None)], [(1, "x")], [1]) == ({"deferred": 1}, [1], [1])


def test_doc_sweep_leaves_code_alone(spark):
    nodes = [*DOCS, (4, "function", "body")]
    vectors = [(1, None), (2, "wrong"), FRESH[2], (4, None)]
    assert run(spark, nodes, vectors, []) == ({"doc_stale": 2, "removed_any": True}, [3, 4], [])
    assert run(spark, nodes, vectors, [], doc_cap=2) == ({}, [1, 2, 3, 4], [])
    assert run(spark, nodes, vectors, [], verify_docs=False) == ({}, [1, 2, 3, 4], [])


def test_kill_recovery(spark):
    n, e, t = tables(spark, [(1, "doc-chunk", "new 1"), (2, "doc-chunk", "new 2"), DOCS[2]], FRESH, [1, 2, 3])
    done = invalidate(n, e, t)
    assert done.report.first().stale == 2 and done.tombstones.isEmpty()
    assert sorted(r.id for r in candidates(n, done.embeddings, "m").collect()) == [1, 2]
    again = invalidate(n, done.embeddings, done.tombstones)
    assert not again.report.first().removed_any


def test_deferred_prose_is_not_pending(spark):
    n, e, t = tables(spark, [(1, "doc-chunk", None)], [(1, "x")], [1])
    assert candidates(n, invalidate(n, e, t).embeddings, "m").isEmpty()


def test_never_embedded_outranks_defer(spark):
    assert run(spark, [(1, "import", None)], [], [1]) == ({"not_embedded": 1}, [], [])


def test_no_ack_keeps_entries(spark):
    assert run(spark, EDITED[1:2], FRESH[1:2], [2], ack=False) == ({"stale": 1, "removed_any": True}, [], [2])


def test_all_models_of_a_node_go(spark):
    n, _, t = tables(spark, EDITED[1:2], [], [2])
    e = spark.createDataFrame([(2, "a", [1.0], "old"), (2, "b", [1.0], H("chunk 2 changed"))], EMBEDDINGS)
    done = invalidate(n, e, t)
    assert done.report.first().stale == 1 and done.report.first().unchanged == 0
    assert [r.model_id for r in done.embeddings.collect()] == ["b"]


@pytest.mark.parametrize("times", [1, 2])
def test_migration(spark, times):
    old = spark.createDataFrame([(1, "m", [1.0])], "node_id long, model_id string, embedding array<float>")
    for _ in range(times):
        old = migrate(old)
    assert old.columns == EMBEDDINGS.names and old.first().text_hash is None


def test_empty_tables(spark):
    assert run(spark, [], [], []) == ({}, [], [])
