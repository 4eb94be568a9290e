import pytest
from pyspark.sql import functions as F

from vecloom import schema
from vecloom.functions import vectors as V
from vecloom.operators import encoder as E
from vecloom.plans import cli, maintain, options, search
from vecloom.sources import descriptor, jsonl
from vecloom.sources.graph import Graph
from vecloom.sources.store import Conflict, Served, Store
from vecloom.streaming import tombstones

D = descriptor.Descriptor(32, "mean", 2, "query: ", 16, "hash")


def graph(spark, texts):
    rows = [(i, "c", "r", f"src/{i}.rs", "rust", f"fn walk_{i}", k, "p", 1, 2, i % 7, t) for i, k, t in texts]
    nodes = spark.createDataFrame(rows, schema.NODES)
    edges = spark.createDataFrame([(1, 2, "call"), (2, 1, "call"), (3, 1, "ref")], schema.EDGES)
    return Graph(nodes, edges, spark.createDataFrame([], schema.TOMBSTONES), spark.createDataFrame([], schema.EMBEDDINGS))


TEXTS = [(1, "function", None), (2, "function", "walks trees"), (3, "file", None), (4, "doc-chunk", "about trees"), (5, "doc-chunk", None), (6, "class", None)]


def test_reindex_search_and_resume(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), graph(spark, TEXTS)
    with pytest.raises(RuntimeError):
        maintain.rebuild(store, g, "m")
    done = maintain.reindex(store, g, "m", D)
    assert (done.state, done.pending) == ("rebuilt", 4)
    assert store.read("index-m-code").count() == 3 and store.read("index-m-docs").count() == 1
    assert store.get("current_embed_model") == "m" and store.get("embed_backend") == "m fp32 dim-16"
    assert maintain.reindex(store, g, "m", D).state == "nothing pending"
    edited = graph(spark, [(i, k, "other words" if i == 4 else t) for i, k, t in TEXTS])
    log = spark.createDataFrame([(4, 0), (99, 0)], schema.TOMBSTONES)
    again = maintain.reindex(store, Graph(edited.nodes, edited.edges, log, edited.embeddings), "m", D)
    assert again.report["stale"] == 1 and again.pending == 1
    s = search.Searcher(store, g, "m", D)
    assert s.knn("other words", 2, "docs")[0][0] == 4
    assert all(len(r.embedding) == 16 for r in store.embeddings().collect())
    assert {r.space: r.n for r in maintain.counts(g, store.embeddings(), "m").collect()} == {"code": 3, "docs": 1}


def test_lazy_nodes_fill_up_and_are_stored(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), graph(spark, TEXTS)
    maintain.reindex(store, g, "m", D, phase=(1, 4))  # shell numbers 4 to 6: nodes 4 and 6
    s = search.Searcher(store, g, "m", D)
    found = s.knn("walk_1 walk_2", 5)
    assert {i for i, _ in found} >= {6, 1, 2}
    assert {1, 2} <= {r.node_id for r in store.embeddings().collect()}
    assert s.answer("x", 3, "nowhere") == []


def test_workers_share_the_work(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), graph(spark, TEXTS)
    assert [maintain.reindex(store, g, "m", D, shard=(i, 2)).state for i in (0, 1)] == ["worker done"] * 2
    assert store.current("index-m-code") is None and store.embeddings().count() == 4
    assert maintain.rebuild(store, g, "m") == {"code": 3, "docs": 1}


def test_cancel(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), graph(spark, TEXTS)
    assert maintain.reindex(store, g, "m", D, cancelled=lambda: True).state == "cancelled"
    assert store.embeddings().isEmpty()


def many(spark, n):
    return graph(spark, [(i, "function", f"text {i}") for i in range(n)])


def test_cancel_half_way_keeps_what_is_stored(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), many(spark, 40)
    done = maintain.reindex(store, g, "m", D, cancelled=lambda: bool(store.view().deltas), chunk_rows=10)
    have = store.embeddings().count()
    assert done.state == "cancelled" and 0 < have < 40 and store.current("index-m-code") is None
    assert not list((tmp_path / "store" / "parked").iterdir())
    again = maintain.reindex(store, g, "m", D, chunk_rows=10)
    assert (again.state, again.pending) == ("rebuilt", 40 - have) and store.read("index-m-code").count() == 40


def test_a_run_that_dies_half_way(spark, tmp_path, monkeypatch):
    store, g = Store(spark, str(tmp_path / "store")), many(spark, 40)
    put, calls = Store.put_embeddings, []

    def dies(self, new, replace=True):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("gone")
        return put(self, new, replace)

    monkeypatch.setattr(Store, "put_embeddings", dies)
    with pytest.raises(OSError):
        maintain.reindex(store, g, "m", D, chunk_rows=10)
    have = store.embeddings().count()
    assert 0 < have < 40 and maintain.reindex(store, g, "m", D).pending == 40 - have


def test_workers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    g = many(spark, 60)
    with ThreadPoolExecutor(3) as pool:
        work = [pool.submit(maintain.reindex, Store(spark, str(tmp_path / "store")), g, "m", D, None, None, (i, 3), chunk_rows=10) for i in range(3)]
        assert {w.result().state for w in work} == {"worker done"}
    store = Store(spark, str(tmp_path / "store"))
    assert sorted(r.node_id for r in store.embeddings().collect()) == list(range(60))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Store(spark, str(tmp_path / "store")).put(f"k{i}", str(i)), range(4)))
    assert [store.get(f"k{i}") for i in range(4)] == ["0", "1", "2", "3"]


def test_what_was_dealt_with_is_not_looked_at_again(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), graph(spark, TEXTS)
    maintain.reindex(store, g, "m", D)
    nodes = graph(spark, [(i, k, None if i == 4 else t) for i, k, t in TEXTS]).nodes
    log = [(2, 5), (4, 5), (99, 5), (2, 4)]
    run = lambda rows: maintain.refresh(store, Graph(nodes, g.edges, spark.createDataFrame(rows, schema.TOMBSTONES), g.embeddings))
    report, left = run(log)
    assert (report["unchanged"], report["deferred"]) == (1, 1) and [r.node_id for r in left.collect()] == [4]
    report, left = run(log)
    assert (report["unchanged"], report["deferred"]) == (0, 1)
    assert run([*log, (2, 6)])[0]["unchanged"] == 1


def test_nodes_that_cannot_be_read(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), many(spark, 3)
    loose = spark.createDataFrame([], schema.NODES.fromJson({**schema.NODES.jsonValue(), "fields": [{**f, "nullable": True} for f in schema.NODES.jsonValue()["fields"]]}))
    bad = g.nodes.withColumn("kind", F.lit(None).cast("string"))
    assert maintain.reindex(store, Graph(loose.unionByName(g.nodes).unionByName(bad), g.edges, g.tombstones, g.embeddings), "m", D).skipped == 3
    with pytest.raises(ValueError, match="none of 3"):
        maintain.reindex(store, Graph(bad, g.edges, g.tombstones, g.embeddings), "m", D)


def test_another_backend_is_told(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), many(spark, 2)
    store.record_backend("m other")
    with pytest.warns(UserWarning, match="made by m other"):
        maintain.reindex(store, g, "m", D)


def test_damaged_snapshots_are_kept_aside(spark, tmp_path):
    now = [0.0]
    store = Store(spark, str(tmp_path / "store"))
    served = Served(store, "t", lambda: now[0])
    store.publish(spark.range(5), "t")
    assert served.get().count() == 5
    v = store.publish(spark.range(6), "t")
    next((tmp_path / "store/t" / v).glob("part-*")).unlink()
    now[0] = 9.0
    assert store.current("t") is None and served.get().count() == 5
    assert v in store.sweep("t") and (tmp_path / "store/t/_quarantine" / v).is_dir()
    store.publish(spark.range(7), "t")
    assert store.read("t").count() == 7


def test_deltas_count_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = lambda i, h: spark.createDataFrame([(i, "m", [1.0], h)], schema.EMBEDDINGS)
    for i, h, replace in ((1, "a", False), (1, "b", False), (2, "a", True), (2, "b", False), (3, "a", False), (3, "b", True), (3, "c", True)):
        store.put_embeddings(row(i, h), replace)
    want = {1: "a", 2: "a", 3: "c"}
    got = lambda: {r.node_id: r.text_hash for r in store.embeddings().collect()}
    assert got() == want
    view = store.view()
    store.put_embeddings(row(4, "late"))
    store.replace_embeddings(view.frame, view)
    assert got() == want | {4: "late"} and len(store.view().deltas) == 1
    with pytest.raises(Conflict):
        store.replace_embeddings(view.frame, view)
    store.compact()
    store.compact()
    assert got() == want | {4: "late"} and not store.view().deltas
    store.sweep("node_embeddings")
    store.put_embeddings(row(1, "z"))
    assert got() == want | {4: "late", 1: "z"}


def test_the_memo_is_traced(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), graph(spark, TEXTS)
    maintain.reindex(store, g, "m", D)
    s = search.Searcher(store, g, "m", D, trace=str(tmp_path / "memo.tsv"))
    for _ in range(2):
        s.knn("about trees", 1, "docs")
    assert (tmp_path / "memo.tsv").read_text() == "QUERY_EMBED_CACHE\tdocs\tmiss\tabout trees\nQUERY_EMBED_CACHE\tdocs\thit\tabout trees\n"


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("t") is None and store.sweep("t") == []
    versions = [store.publish(spark.range(n), "t") for n in (1, 2, 3)]
    assert store.current("t") == versions[-1] and store.read("t").count() == 3
    store.publish(store.read("t").filter("id > 0"), "t")
    assert store.read("t").count() == 2
    spark.range(9).write.parquet(str(tmp_path / "store/t/v9-half"))
    (tmp_path / "store/t/v9-half/_SUCCESS").unlink()
    assert "v9-half" not in store.versions("t")
    assert "v9-half" in store.sweep("t") and len(store.versions("t")) == 2 and store.read("t").count() == 2
    assert store.record_backend("a") is None and store.record_backend("a") is None and store.record_backend("b") == "a"


def test_serving_keeps_what_it_has(spark, tmp_path):
    now = [0.0]
    store = Store(spark, str(tmp_path / "store"))
    served = Served(store, "t", lambda: now[0])
    assert served.get() is None
    store.publish(spark.range(1), "t")
    assert served.get().count() == 1
    store.publish(spark.range(2), "t")
    now[0] = 1.0
    assert served.get().count() == 1
    now[0] = 6.0
    assert served.get().count() == 2
    assert [Served.due(*x) for x in ((True, None), (True, 0.1), (True, 5), (False, None))] == [True, False, True, False]


def test_memo():
    now, made, said = [0.0], [], []
    memo = search.Memo(lambda t: made.append(t) or [1.0], lambda: now[0], said.append)
    for at, text in ((0, "a"), (7, "a"), (59, "a"), (60, "a"), (61, "A")):
        now[0] = at
        memo.get(text)
    assert made == ["a", "a", "A"] and [s.split("\t")[2] for s in said] == ["miss", "hit", "hit", "miss", "miss"]


def test_upsert_and_ignore(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = lambda i, h: spark.createDataFrame([(i, "m", [1.0], h)], schema.EMBEDDINGS)
    store.put_embeddings(row(1, "a"))
    store.put_embeddings(row(1, "b"))
    store.put_embeddings(row(1, "c").unionByName(row(2, "d")), replace=False)
    assert {r.node_id: r.text_hash for r in store.embeddings().collect()} == {1: "b", 2: "d"}


def test_stream_is_as_the_batch(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "store")), graph(spark, TEXTS)
    maintain.reindex(store, g, "m", D)
    edited = graph(spark, [(i, k, None if i == 4 else "changed" if i == 2 else t) for i, k, t in TEXTS])
    for i in (2, 4, 99):
        spark.createDataFrame([(i, 0)], schema.TOMBSTONES).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    for _ in range(2):
        tombstones.follow(tombstones.read_log(spark, str(tmp_path / "log"), 1), store, lambda: edited.nodes, str(tmp_path / "cp")).awaitTermination()
        assert sorted(r.node_id for r in store.embeddings().collect()) == [1, 4, 6]
        assert [r.node_id for r in store.read("waiting").collect()] == [4]


def test_tagged_work_returns(spark):
    assert tombstones.run_tagged(spark, "t", lambda: spark.range(3).count()) == 3
    tombstones.cancel(spark, "t")


def test_lines_of_json(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id":"b","text":"a longer text"}\n\n{"id":"a\\"","text":"x"}\n')
    texts = jsonl.read_texts(spark, str(tmp_path / "in.jsonl"))
    jsonl.write_lines(jsonl.embed_lines(texts, D), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [jsonl.string_field(x, "id") for x in lines] == ["b", 'a"']
    import base64

    got = V.unpacked(base64.b64decode(jsonl.string_field(lines[1], "b64")))
    assert got.tolist() == E.HashEncoder(D).embed_documents(["x"])[0].tolist()
    asked = jsonl.embed_lines(texts, D, queries=True).orderBy("place").collect()
    assert V.unpacked(base64.b64decode(asked[1].b64)).tolist() == E.HashEncoder(D).embed_query("x").tolist()
    (tmp_path / "bad.jsonl").write_text('{"id":"b"}\n')
    with pytest.raises(Exception, match="lacks id or text"):
        jsonl.read_texts(spark, str(tmp_path / "bad.jsonl")).collect()
    assert jsonl.string_field('{"k":"\\u00e9\\ud83d\\ude00"}', "k") == "é😀" and jsonl.string_field("{}", "k") is None and jsonl.string_field("[", "k") is None


def engine(name, rank, does, families=None):
    """An engine that gives its own name, declines (None) or raises."""

    def build(folder, d):
        if isinstance(does, Exception):
            raise does
        return does and name

    return E.Factory(name, rank, build, families)


def test_the_best_engine_that_works_is_taken():
    d = descriptor.Descriptor(8, "cls", 2, family="f")
    broken, fine = OSError("no driver"), True
    fast, own, slow = (lambda x, n=n, r=r, fam=fam: engine(n, r, x, fam) for n, r, fam in (("fast", 100, None), ("own", 50, ("f", "g")), ("slow", 10, None)))
    other = descriptor.Descriptor(8, "cls", 2, family="h")
    assert E.resolve([slow(fine), own(fine), fast(fine)], None, d) == "fast"
    assert E.resolve([slow(fine), own(fine), fast(None)], None, d) == "own"
    assert E.resolve([slow(fine), own(fine), fast(broken)], None, other) == "slow"
    with pytest.raises(RuntimeError, match="'f'.*no driver.*declined"):
        E.resolve([fast(broken), own(None)], None, d)
    with pytest.raises(RuntimeError, match="other families"):
        E.resolve([own(fine)], None, other)
    with pytest.raises(RuntimeError, match="no engine is left"):
        E.resolve([], None, d)


def test_choices_of_engines():
    have = [engine("ort", 100, True), engine("tract", 50, True, ("bert",)), engine("cpu", 10, True)]
    took = {}
    for word, (only, ranks) in descriptor.PLATFORM_RULES.items():
        for family in ("bert", "other"):
            d = descriptor.Descriptor(8, "cls", 2, family=family, macos_engine=word)
            try:
                took[word, family] = E.resolve(have, None, d, E.Choice(only, tuple(ranks.items())))
            except RuntimeError:
                took[word, family] = None
    assert took == {("auto", "bert"): "tract", ("auto", "other"): "ort", ("tract", "bert"): "tract", ("tract", "other"): None, ("ort", "bert"): "ort", ("ort", "other"): "ort"}
    assert E.chosen(" CPU ", have) == E.Choice("cpu") and E.chosen("auto", have) == E.chosen("", have) == E.chosen(None, have) == E.Choice()
    with pytest.warns(UserWarning, match="gpu"):
        assert E.chosen("gpu", have) == E.Choice()
    c = E.capabilities(have)
    assert c["engines"] == ["ort", "tract", "cpu"] and c["families"] == ["bert"] and c["universal_onnx"] and c["accelerated_compiled"] and c["capabilities_version"] == 1
    assert not E.capabilities(have[1:2])["universal_onnx"]


def test_model_pipeline():
    d = descriptor.Descriptor(4, "cls", 2)
    with pytest.raises(ValueError):
        E.run_model(["a"], lambda t: [[1, 2]], lambda i, m: i[..., None] * 1.0, d)
    ids, mask = E.token_batch([[1] * 600, [2]])
    assert ids.shape == (2, 512) and mask.sum() == 513
    assert E.run_model([], None, None, d).shape == (0, 4)


def test_descriptor():
    d = descriptor.parse('dim = 8\npooling = "mean"\nn_inputs = 3\ntruncate_dim = 4\nother = 1')
    assert (d.output_dim, d.query_prefix, d.family, d.macos_engine) == (4, "", "bert", "auto")
    for bad in ("dim = 0", 'dim = 8\nn_inputs = 4', 'dim = 8\ntruncate_dim = 9', 'dim = 8\nfamily = " "'):
        with pytest.raises((ValueError, TypeError)):
            descriptor.parse(bad + ("" if "n_inputs" in bad else "\nn_inputs = 2") + '\npooling = "cls"')


@pytest.mark.parametrize(
    "args",
    [
        "",
        "--what",
        "--reindex",
        "--shard 0/2 --db-path x",
        "--reindex x --shard 2/2",
        "--reindex x --shard 1",
        "--reindex x --shard 0/0",
        "--reindex x --row-start 1",
        "--reindex x --row-start 5 --row-end 5",
        "--row-start 1 --row-end 2 --db-path x",
        "--reindex x --row-start 1 --row-end 2 --shard 0/2",
        "--reindex x --parallel 0",
        "--parallel 2 --db-path x",
        "--reindex x --parallel 2 --shard 0/2",
        "--reindex x --cancel-sentinel s",
        "--reindex x --parallel 2 --rebuild-on-cancel",
        "--reindex x --rebuild-index y",
    ],
)
def test_wrong_command_lines(args, capsys):
    assert cli.main(args.split()) == 1


def test_command_lines(capsys):
    assert cli.main(["--reindex", "--version"]) == 0
    assert cli.main(["--capabilities", "--what"]) == 0
    assert '"capabilities_version": 1' in capsys.readouterr().out
    o = options.parse("--reindex g --phase1 3 --phase2 4 --parallel 2 --cancel-sentinel s --rebuild-on-cancel --busy-timeout-ms 5".split())
    assert (o.mode, o.db, o.phase, o.parallel, o.busy_timeout_ms, o.model_id) == ("reindex", "g", (2, 4), 2, 5, "bge-small-en-v1.5")
    assert options.parse(["--db-path", "g"]).mode == "serve" and options.parse(["--rebuild-index", "g"]).mode == "rebuild"
    assert options.parse("--reindex g --row-start -5 --row-end 5".split()).rows == (-5, 5)
    assert cli.main(["--db-path", "g", "--model-id", "no-such-model"]) == 1
