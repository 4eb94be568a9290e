from vecloom.functions import predicates as P
from pyspark.sql import functions as F


def ids(df, where):
    return sorted(r.id for r in df.filter(where).collect())


ROWS = [(1, "file", "x"), (2, "file", None), (3, "function", None), (4, "import", None), (5, "doc-chunk", "x"), (6, "doc-chunk", None), (7, None, "x"), (8, None, None), (9, "package", "x")]


def test_spaces_and_null_kinds(spark):
    df = spark.createDataFrame(ROWS, "id long, kind string, embed_text string")
    assert ids(df, P.embeddable()) == [1, 3, 5, 7, 9]
    assert ids(df, P.in_code_space()) == [1, 3, 9]
    assert ids(df, P.in_doc_space()) == [5, 6]


def test_phase_shard_and_rows(spark):
    df = spark.createDataFrame([(-3, 1), (-1, 5), (0, None), (4, 9)], "id long, shell_number int")
    assert ids(df, P.in_phase((1, 5))) == [-1, 4]
    assert ids(df, P.in_phase((2, 5))) == [-3]
    assert ids(df, P.in_phase(None)) == [-3, -1, 0, 4]
    assert sorted(i for s in range(3) for i in ids(df, P.in_shard(s, 3))) == [-3, -1, 0, 4]
    assert ids(df, P.in_rows(-1, 4)) == [-1, 0]


def test_paths_of_tests_ignore_case(spark):
    df = spark.createDataFrame([(1, "a/mod_TEST.rs"), (2, "a/testing/b.rs"), (3, "test/x"), (4, "src/contest/x"), (5, "a/modXtest.rs"), (6, None)], "id long, path string")
    assert ids(df, P.in_tests(F.col("path"))) == [1, 2, 3, 5]
