import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from vecloom.llm import common, simhash  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    toxic, lines, near, leaks, coded = counts[1:]
    assert counts[0] > toxic == lines > near >= leaks == coded
    assert docs.select("doc_id").distinct().count() == coded
    whole = pipeline.run(spark, DIR)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_near_duplicates_leave_one(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = pipeline.drop_near_duplicates(spark, docs, DIR)
    of = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5).collect()}
    assert {r.doc_id for r in kept.collect()} == set(of.values())


def test_release_spares_what_is_read(spark):
    first = common.made()
    a, b = common.materialise(spark.range(3), "a"), common.materialise(spark.range(4), "b")
    common.release(first, common.made(), used_by=b)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()
