"""One query for each operator of the engine, over the derived graph, with its SQL where there is one.

The hash is md5 here, which SQL has too; production uses functions.hashing.text_hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing
from .functions import predicates as P
from .functions import text as T
from .functions import vectors as V
from .operators import batching, encoder, freshness, fts, knn, pending, upserts
from .operators.numbering import numbered
from .schema import DOC_KIND, EMBEDDINGS, STRUCTURAL_KINDS, migrate
from .sources.descriptor import Descriptor
from .sources.graph import WITH, Graph, derived
from .sources.jsonl import parsed_lines

Query = Callable[[SparkSession, str], DataFrame]
MODEL = "m1"
PHASE = 5
SHARDS = 7
K = 10
SEARCH = "this ther tionen with"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

KINDS = ", ".join(f"'{k}'" for k in STRUCTURAL_KINDS)
ELIGIBLE = f"((n.kind NOT IN ({KINDS}) OR n.embed_text IS NOT NULL) AND NOT (n.kind = '{DOC_KIND}' AND n.embed_text IS NULL))"
CODE = f"(n.kind <> '{DOC_KIND}' AND (n.kind NOT IN ({KINDS}) OR n.embed_text IS NOT NULL))"
TESTS = "(n.path ILIKE '%_test.%' OR n.path ILIKE '%/testing/%' OR n.path ILIKE 'test/%')"
MISSING = f"NOT EXISTS (SELECT 1 FROM node_embeddings e WHERE e.node_id = n.id AND e.model_id = '{MODEL}')"


def query(sql: str | None = None) -> Callable[[Callable[[Graph], DataFrame]], Query]:
    def register(f: Callable[[Graph], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(derived(spark, sf_dir))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = f"{WITH}{sql}" if sql.startswith(",") else f"{WITH} {sql}"
        return run

    return register


def _near(of: str, other: str, name: str) -> str:
    return f"""{name} AS (SELECT id, string_agg(sig, ', ' ORDER BY rank) AS {name} FROM (
  SELECT e.{of} AS id, substr(n.signature, 1, 60) AS sig, row_number() OVER (PARTITION BY e.{of} ORDER BY e.{other}, e.kind) AS rank
  FROM edges e JOIN nodes n ON n.id = e.{other} WHERE n.kind NOT IN ({KINDS})) WHERE rank <= 5 GROUP BY id)"""


NEAR = f"{_near('dst', 'src', 'callers')}, {_near('src', 'dst', 'callees')}"
NODE_TEXT = """coalesce(n.kind, '') || ': ' || coalesce(n.signature, '')
  || CASE WHEN coalesce(n.path, '') <> '' THEN ' | module: ' || n.path ELSE '' END
  || CASE WHEN coalesce(callers.callers, '') <> '' THEN ' | callers: ' || callers.callers ELSE '' END
  || CASE WHEN coalesce(callees.callees, '') <> '' THEN ' | callees: ' || callees.callees ELSE '' END"""
PENDING = f""", {NEAR}, pending AS (SELECT n.id, coalesce(n.embed_text, {NODE_TEXT}) AS text, CASE WHEN {TESTS} THEN 0 ELSE 1 END AS not_test, n.shell_number
  FROM nodes n LEFT JOIN callers ON callers.id = n.id LEFT JOIN callees ON callees.id = n.id WHERE {ELIGIBLE} AND {MISSING})"""


@query(f"{PENDING} SELECT id, md5(text) AS text_md5, CAST(strlen(text) // 4 + 4 AS BIGINT) AS est_tokens, not_test, shell_number FROM pending")
def pending_nodes(g: Graph) -> DataFrame:
    return pending.pending(g.nodes, g.edges, g.embeddings, MODEL).select("id", F.md5("text").alias("text_md5"), "est_tokens", "not_test", "shell_number")


@query(f"{PENDING} SELECT id, md5(text) AS text_md5, not_test, shell_number, row_number() OVER (ORDER BY not_test DESC, shell_number DESC NULLS LAST, id) - 1 AS place FROM pending")
def pending_serial_order(g: Graph) -> DataFrame:
    rows = pending.pending(g.nodes, g.edges, g.embeddings, MODEL).select("id", F.md5("text").alias("text_md5"), "not_test", "shell_number")
    return numbered(rows, ["not_test", "shell_number"], pending.serial_order()[:-1])


@query(f"{PENDING} SELECT id, md5(text) AS text_md5, shell_number, row_number() OVER (ORDER BY shell_number DESC NULLS LAST, id) - 1 AS place FROM pending")
def pending_parallel_order(g: Graph) -> DataFrame:
    rows = pending.pending(g.nodes, g.edges, g.embeddings, MODEL).select("id", F.md5("text").alias("text_md5"), "shell_number")
    return numbered(rows, ["shell_number"], pending.parallel_order()[:-1])


@query(
    f"""SELECT count(*) AS every, CAST(sum(CASE WHEN shell_number >= {PHASE} THEN 1 ELSE 0 END) AS BIGINT) AS first, CAST(sum(CASE WHEN shell_number < {PHASE} THEN 1 ELSE 0 END) AS BIGINT) AS second
  FROM nodes n WHERE {ELIGIBLE} AND {MISSING}"""
)
def pending_counts_by_phase(g: Graph) -> DataFrame:
    part = lambda p: F.sum(F.coalesce(P.in_phase(p), F.lit(False)).cast("long"))
    return pending.candidates(g.nodes, g.embeddings, MODEL).agg(F.count(F.lit(1)).alias("every"), part((1, PHASE)).alias("first"), part((2, PHASE)).alias("second"))


@query(f"SELECT CAST(((n.id % {SHARDS}) + {SHARDS}) % {SHARDS} AS INTEGER) AS shard, count(*) AS n FROM nodes n WHERE {ELIGIBLE} AND {MISSING} GROUP BY 1")
def pending_by_shard(g: Graph) -> DataFrame:
    shards = [pending.candidates(g.nodes, g.embeddings, MODEL, where=P.in_shard(i, SHARDS)).select(F.lit(i).alias("shard")) for i in range(SHARDS)]
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s)
    return every.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n.id FROM nodes n WHERE {ELIGIBLE} AND {MISSING} AND n.id >= 200 AND n.id < 700")
def pending_row_range(g: Graph) -> DataFrame:
    return pending.candidates(g.nodes, g.embeddings, MODEL, where=P.in_rows(200, 700)).select("id")


@query(f"SELECT n.id, n.kind FROM nodes n WHERE {ELIGIBLE}")
def embeddable_nodes(g: Graph) -> DataFrame:
    return g.nodes.filter(P.embeddable()).select("id", "kind")


@query(f"SELECT n.id FROM nodes n WHERE {CODE}")
def code_space_nodes(g: Graph) -> DataFrame:
    return g.nodes.filter(P.in_code_space()).select("id")


@query(f"SELECT n.id FROM nodes n WHERE n.kind = '{DOC_KIND}'")
def doc_space_nodes(g: Graph) -> DataFrame:
    return g.nodes.filter(P.in_doc_space()).select("id")


@query(f"SELECT n.id, n.path FROM nodes n WHERE {TESTS}")
def test_paths(g: Graph) -> DataFrame:
    return g.nodes.filter(P.in_tests(F.col("path"))).select("id", "path")


@query(f", {NEAR} SELECT n.id, callers.callers, callees.callees FROM nodes n LEFT JOIN callers ON callers.id = n.id LEFT JOIN callees ON callees.id = n.id")
def neighbours(g: Graph) -> DataFrame:
    return pending.enriched(g.nodes, g.edges, g.nodes.select("id")).select("id", "callers", "callees")


@query(f", {NEAR} SELECT n.id, md5({NODE_TEXT}) AS text_md5 FROM nodes n LEFT JOIN callers ON callers.id = n.id LEFT JOIN callees ON callees.id = n.id")
def node_texts(g: Graph) -> DataFrame:
    return pending.enriched(g.nodes, g.edges, g.nodes.select("id", "kind", "signature", "path")).select("id", F.md5(T.node_text()).alias("text_md5"))


_SEQ = "CASE WHEN est <= 32 THEN 32 WHEN est <= 64 THEN 64 WHEN est <= 128 THEN 128 WHEN est <= 256 THEN 256 ELSE 512 END"
_CAP = "CASE seq WHEN 32 THEN 128 WHEN 64 THEN 64 WHEN 128 THEN 32 WHEN 256 THEN 16 ELSE 8 END"
_SHAPES = f""", items AS (SELECT n.id, CAST(strlen(n.embed_text) // 4 + 4 AS BIGINT) AS est FROM nodes n WHERE n.embed_text IS NOT NULL),
  shaped AS (SELECT id, est, {_SEQ} AS seq FROM items),
  capped AS (SELECT id, est, seq, {_CAP} AS cap FROM shaped),
  placed AS (SELECT *, (row_number() OVER (PARTITION BY seq ORDER BY est, id) - 1) // cap AS batch FROM capped)"""


def _items(g: Graph) -> DataFrame:
    return g.nodes.filter("embed_text IS NOT NULL").select("id", T.estimated_tokens(F.col("embed_text")).alias("est_tokens"))


@query(f"{_SHAPES} SELECT id, est AS est_tokens, seq, cap, CAST(batch AS BIGINT) AS batch FROM placed")
def shape_batches(g: Graph) -> DataFrame:
    return batching.shape_batches(_items(g))


@query(
    f"""{_SHAPES} SELECT seq, batch, n AS rows, CAST(CASE WHEN n >= cap THEN n ELSE least(pow(2, ceil(log2(n))), cap) END AS INTEGER) AS padded
  FROM (SELECT seq, CAST(batch AS BIGINT) AS batch, any_value(cap) AS cap, count(*) AS n FROM placed GROUP BY seq, batch)"""
)
def batch_shapes(g: Graph) -> DataFrame:
    sizes = batching.shape_batches(_items(g)).groupBy("seq", "batch").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.withColumn("padded", T.padded_rows(F.col("rows"), F.col("seq")).cast("int"))


@query(
    """, items AS (SELECT n.id, CAST(strlen(n.embed_text) // 4 + 4 AS BIGINT) AS est FROM nodes n WHERE n.embed_text IS NOT NULL),
  line AS (SELECT id, est, row_number() OVER (ORDER BY est, id) AS i FROM items),
  fold AS (SELECT i, id, est, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS rows, est AS longest FROM line WHERE i = 1
    UNION ALL SELECT l.i, l.id, l.est,
      CASE WHEN greatest(f.longest, l.est) * (f.rows + 1) > 4096 OR f.rows >= 512 THEN f.batch + 1 ELSE f.batch END,
      CASE WHEN greatest(f.longest, l.est) * (f.rows + 1) > 4096 OR f.rows >= 512 THEN 1 ELSE f.rows + 1 END,
      CASE WHEN greatest(f.longest, l.est) * (f.rows + 1) > 4096 OR f.rows >= 512 THEN l.est ELSE greatest(f.longest, l.est) END
    FROM fold f JOIN line l ON l.i = f.i + 1)
  SELECT id, est AS est_tokens, 0 AS chunk, batch FROM fold"""
)
def token_batches(g: Graph) -> DataFrame:
    return batching.token_batches(_items(g), batching.token_budget(1))


_INVALID = f""", t AS (SELECT DISTINCT node_id FROM node_tombstones),
  known AS (SELECT n.id, n.kind, md5(n.embed_text) AS digest, t.node_id IS NOT NULL AS logged FROM nodes n LEFT JOIN t ON t.node_id = n.id),
  fates AS (SELECT e.node_id, e.model_id, e.text_hash, CASE WHEN k.id IS NULL THEN 'orphan'
      WHEN k.logged AND k.digest IS NOT NULL AND (e.text_hash IS NULL OR e.text_hash <> k.digest) THEN 'stale'
      WHEN k.kind = '{DOC_KIND}' AND k.digest IS NOT NULL AND (e.text_hash IS NULL OR e.text_hash <> k.digest) THEN 'doc_stale' ELSE 'keep' END AS fate
    FROM node_embeddings e LEFT JOIN known k ON k.id = e.node_id),
  checked AS (SELECT k.id, k.digest, count(f.node_id) AS vectors, sum(CASE WHEN f.fate = 'stale' THEN 1 ELSE 0 END) AS bad
    FROM known k LEFT JOIN fates f ON f.node_id = k.id AND f.fate <> 'orphan' WHERE k.logged GROUP BY k.id, k.digest)"""
_REPORT = f"""{_INVALID}, a AS (SELECT CAST(sum(CASE WHEN vectors > 0 AND digest IS NOT NULL AND bad = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unchanged,
    CAST(sum(CASE WHEN vectors > 0 AND digest IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS deferred, CAST(sum(CASE WHEN vectors = 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_embedded FROM checked),
  b AS (SELECT CAST(sum(CASE WHEN fate = 'stale' THEN 1 ELSE 0 END) AS BIGINT) AS stale, CAST(sum(CASE WHEN fate = 'orphan' THEN 1 ELSE 0 END) AS BIGINT) AS orphaned,
    CAST(sum(CASE WHEN fate = 'doc_stale' THEN 1 ELSE 0 END) AS BIGINT) AS doc_stale FROM fates)"""


def _invalidated(g: Graph, **options: object) -> freshness.Invalidation:
    return freshness.invalidate(g.nodes, g.embeddings, g.tombstones, hash_fn=hashing.md5, **options)


@query(f"{_REPORT} SELECT a.*, b.*, stale + orphaned + doc_stale > 0 AS removed_any FROM a, b")
def invalidation_report(g: Graph) -> DataFrame:
    return _invalidated(g).report


@query(f"{_REPORT} SELECT a.*, b.stale, b.orphaned, CAST(0 AS BIGINT) AS doc_stale, stale + orphaned > 0 AS removed_any FROM a, b")
def invalidation_beyond_doc_cap(g: Graph) -> DataFrame:
    return _invalidated(g, doc_cap=1).report


@query(f"{_INVALID} SELECT node_id, model_id, text_hash FROM fates WHERE fate = 'keep'")
def invalidation_kept_vectors(g: Graph) -> DataFrame:
    return _invalidated(g).embeddings.select("node_id", "model_id", "text_hash")


@query(f"{_INVALID} SELECT node_id, model_id, fate FROM fates")
def vector_fates(g: Graph) -> DataFrame:
    return _invalidated(g).fates.select("node_id", "model_id", "fate")


@query(f"{_INVALID} SELECT t.node_id, count(*) AS n FROM node_tombstones t JOIN checked c ON c.id = t.node_id WHERE c.vectors > 0 AND c.digest IS NULL GROUP BY t.node_id")
def tombstones_waiting(g: Graph) -> DataFrame:
    return _invalidated(g).tombstones.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_INVALID} SELECT t.node_id, count(*) AS n FROM node_tombstones t JOIN checked c ON c.id = t.node_id WHERE c.vectors > 0 AND c.digest IS NULL GROUP BY t.node_id")
def tombstones_after_reindex(g: Graph) -> DataFrame:
    """What the next run still finds in the log, once this one's dealt-with entries are stored."""
    acked = freshness.acknowledged(g.tombstones, _invalidated(g).tombstones)
    return freshness.unacknowledged(g.tombstones, acked).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT node_id, count(*) AS n FROM node_tombstones GROUP BY node_id")
def tombstones_without_ack(g: Graph) -> DataFrame:
    return _invalidated(g, ack=False).tombstones.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT t.node_id, n.kind, EXISTS (SELECT 1 FROM node_embeddings e WHERE e.node_id = t.node_id) AS has_vector FROM node_tombstones t JOIN nodes n ON n.id = t.node_id")
def logged_nodes(g: Graph) -> DataFrame:
    have = g.embeddings.select("node_id").distinct().withColumn("has", F.lit(True))
    known = g.tombstones.select("node_id").distinct().join(g.nodes.select(F.col("id").alias("node_id"), "kind"), "node_id")
    return known.join(have, "node_id", "left").select("node_id", "kind", F.col("has").isNotNull().alias("has_vector"))


@query("SELECT e.node_id, e.model_id FROM node_embeddings e WHERE e.node_id NOT IN (SELECT id FROM nodes)")
def orphan_vectors(g: Graph) -> DataFrame:
    return g.embeddings.join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("node_id", "model_id")


@query("SELECT e.node_id, e.model_id FROM node_embeddings e WHERE e.node_id IN (SELECT id FROM nodes)")
def delete_orphans(g: Graph) -> DataFrame:
    return upserts.delete_orphans(g.embeddings, g.nodes).select("node_id", "model_id")


@query("SELECT DISTINCT t.node_id FROM node_tombstones t WHERE t.node_id NOT IN (SELECT id FROM nodes)")
def orphan_tombstones(g: Graph) -> DataFrame:
    return g.tombstones.select("node_id").distinct().join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")


@query("SELECT e.node_id, e.model_id, e.text_hash FROM node_embeddings e JOIN nodes n ON n.id = e.node_id WHERE n.embed_text IS NOT NULL AND (e.text_hash IS NULL OR e.text_hash <> md5(n.embed_text))")
def hash_mismatches(g: Graph) -> DataFrame:
    digests = g.nodes.filter("embed_text IS NOT NULL").select(F.col("id").alias("node_id"), F.md5("embed_text").alias("digest"))
    return g.embeddings.join(digests, "node_id").filter(P.hash_differs(F.col("text_hash"), F.col("digest"))).select("node_id", "model_id", "text_hash")


@query("SELECT e.node_id, e.model_id FROM node_embeddings e LEFT JOIN nodes n ON n.id = e.node_id WHERE n.embed_text IS NULL OR e.text_hash = md5(n.embed_text)")
def delete_stale(g: Graph) -> DataFrame:
    digests = g.nodes.filter("embed_text IS NOT NULL").select(F.col("id").alias("node_id"), F.md5("embed_text").alias("digest"))
    return upserts.delete_stale(g.embeddings, digests).select("node_id", "model_id")


@query("SELECT node_id, count(*) AS n FROM node_tombstones WHERE node_id % 3 <> 0 GROUP BY node_id")
def acknowledge(g: Graph) -> DataFrame:
    return upserts.acknowledge(g.tombstones, g.tombstones.filter("node_id % 3 = 0")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n.id FROM nodes n WHERE n.kind = '{DOC_KIND}' AND n.embed_text IS NOT NULL AND EXISTS (SELECT 1 FROM node_embeddings e WHERE e.node_id = n.id)")
def docs_with_vectors(g: Graph) -> DataFrame:
    return g.nodes.filter(P.in_doc_space() & F.col("embed_text").isNotNull()).join(g.embeddings.select(F.col("node_id").alias("id")), "id", "left_semi").select("id")


_NEW = """new AS (SELECT vec_id * 2 AS node_id, 'm1' AS model_id, 'fresh' AS text_hash FROM embeddings)"""


def _fresh(g: Graph) -> DataFrame:
    made = g.embeddings.filter("model_id = 'm1'").select(F.when(F.col("node_id") >= 1_000_000, F.col("node_id") - 1_000_000).otherwise(F.col("node_id")).alias("v"), "embedding")
    return made.select((F.col("v") * 2).alias("node_id"), F.lit("m1").alias("model_id"), "embedding", F.lit("fresh").alias("text_hash"))


@query(f", {_NEW} SELECT * FROM new UNION ALL SELECT node_id, model_id, text_hash FROM node_embeddings e WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.node_id = e.node_id AND new.model_id = e.model_id)")
def upsert(g: Graph) -> DataFrame:
    return upserts.upsert(g.embeddings, _fresh(g)).select("node_id", "model_id", "text_hash")


@query(f", {_NEW} SELECT node_id, model_id, text_hash FROM node_embeddings UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM node_embeddings e WHERE new.node_id = e.node_id AND new.model_id = e.model_id)")
def insert_ignore(g: Graph) -> DataFrame:
    return upserts.insert_ignore(g.embeddings, _fresh(g)).select("node_id", "model_id", "text_hash")


@query(
    f""", {_NEW}, writes AS (SELECT node_id, model_id, text_hash, 10 AS written FROM new UNION ALL SELECT node_id, model_id, 'later', 20 FROM new WHERE node_id % 3 = 0
    UNION ALL SELECT node_id + 1, model_id, 'added', -15 FROM new UNION ALL SELECT node_id + 1, model_id, 'added first', -5 FROM new WHERE node_id % 5 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY node_id, model_id ORDER BY written DESC) AS k FROM (
    SELECT * FROM writes UNION ALL SELECT node_id, model_id, text_hash, 0 FROM node_embeddings)) SELECT node_id, model_id, text_hash FROM ranked WHERE k = 1"""
)
def folded_writes(g: Graph) -> DataFrame:
    """Writes at 10 and 20 that replace, and at 5 and 15 that only add."""
    new = _fresh(g)
    add = new.withColumn("node_id", F.col("node_id") + 1)
    writes = [(new, None, 10), (new.filter("node_id % 3 = 0"), "later", 20), (add, "added", -15), (add.filter("(node_id - 1) % 5 = 0"), "added first", -5)]
    parts = [(df if name is None else df.withColumn("text_hash", F.lit(name))).withColumn("at", F.lit(at)) for df, name, at in writes]
    return upserts.fold(g.embeddings, parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])).select("node_id", "model_id", "text_hash")


@query("SELECT node_id, model_id, CAST(NULL AS VARCHAR) AS text_hash FROM node_embeddings WHERE model_id = 'm2'")
def migrate_legacy(g: Graph) -> DataFrame:
    return migrate(g.embeddings.filter("model_id = 'm2'").drop("text_hash"), EMBEDDINGS).select("node_id", "model_id", "text_hash")


@query(
    f"""SELECT 'code' AS space, e.model_id, count(*) AS n FROM node_embeddings e JOIN nodes n ON n.id = e.node_id WHERE {CODE} GROUP BY e.model_id
  UNION ALL SELECT 'docs', e.model_id, count(*) FROM node_embeddings e JOIN nodes n ON n.id = e.node_id WHERE n.kind = '{DOC_KIND}' GROUP BY e.model_id"""
)
def space_counts(g: Graph) -> DataFrame:
    parts = [knn.space_vectors(g.nodes, g.embeddings, m, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("space"), F.lit(m).alias("model_id"), "n") for s in ("code", "docs") for m in ("m1", "m2")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _knn_sql(where: str) -> str:
    return f"""SELECT query_id, node_id, distance, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - distance)) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query_id, node_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.node_id, round(1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS distance
    FROM embeddings q, node_embeddings e JOIN nodes n ON n.id = e.node_id WHERE q.vec_id % 20 = 0 AND e.model_id = '{MODEL}' AND {where})) WHERE rank <= {K}"""


def _asked(g: Graph) -> DataFrame:
    own = F.when(F.col("node_id") >= 1_000_000, F.col("node_id") - 1_000_000).otherwise(F.col("node_id"))
    return g.embeddings.filter("model_id = 'm1'").select(own.alias("query_id"), "embedding").filter("query_id % 20 = 0")


@query(_knn_sql(CODE))
def knn_code(g: Graph) -> DataFrame:
    return knn.exact(_asked(g), knn.space_vectors(g.nodes, g.embeddings, MODEL, "code"), K)


@query(_knn_sql(f"n.kind = '{DOC_KIND}'"))
def knn_docs(g: Graph) -> DataFrame:
    return knn.exact(_asked(g), knn.space_vectors(g.nodes, g.embeddings, MODEL, "docs"), K)


@query(
    f"""SELECT node_id, distance, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - distance)) AS similarity FROM (SELECT e.node_id, round(1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS distance
  FROM embeddings q, node_embeddings e JOIN nodes n ON n.id = e.node_id WHERE q.vec_id = 42 AND e.model_id = '{MODEL}' AND {CODE}) ORDER BY distance, node_id LIMIT {K}"""
)
def knn_single(g: Graph) -> DataFrame:
    query = g.embeddings.filter("model_id = 'm1' AND node_id = 42").first().embedding
    return knn.one(query, knn.space_vectors(g.nodes, g.embeddings, MODEL, "code"), K)


@query()
def knn_inverted_file(g: Graph) -> DataFrame:
    vectors = knn.space_vectors(g.nodes, g.embeddings, MODEL, "code")
    index = knn.InvertedFile.fit(vectors, cells=16)
    return index.search(_asked(g), index.assign(vectors), K)


def _terms(query: str) -> list[str]:
    return sorted({w for w in query.lower().split() if len(w) >= 4}, key=lambda w: (-len(w), w))[:3]


def _bm25() -> str:
    terms = _terms(SEARCH)
    met = ", ".join(f"sum(CASE WHEN contains(s, '{t}') THEN 1 ELSE 0 END) AS m{i}" for i, t in enumerate(terms))
    part = " + ".join(
        f"greatest(ln((n - m{i} + 0.5) / (m{i} + 0.5)), 1e-6) * (((length(s) - length(replace(s, '{t}', ''))) / {len(t)}) * 2.2) / (((length(s) - length(replace(s, '{t}', ''))) / {len(t)}) + 1.2 * (0.25 + 0.75 * size / mean))"
        for i, t in enumerate(terms)
    )
    some = " OR ".join(f"contains(s, '{t}')" for t in terms)
    return f""", d AS (SELECT id, lower(coalesce(signature, '')) AS s, greatest(length(lower(coalesce(signature, ''))) - 2, 0) AS size FROM nodes),
  c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(size) AS mean, {met} FROM d),
  fts AS (SELECT id AS node_id, round({part}, 6) AS score FROM d, c WHERE {some} ORDER BY score DESC, id LIMIT 20)"""


@query(f"{_bm25()} SELECT node_id, score, CAST(row_number() OVER (ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM fts")
def fts_candidates(g: Graph) -> DataFrame:
    return fts.candidates(g.nodes, SEARCH)


@query(
    f"""{_bm25()}, found AS (SELECT node_id, 1 - distance AS similarity, 0 AS late, row_number() OVER (ORDER BY distance, node_id) AS rank FROM (
    SELECT e.node_id, round(1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings q, node_embeddings e JOIN nodes n ON n.id = e.node_id
    WHERE q.vec_id = 42 AND e.model_id = '{MODEL}' AND {CODE}) ORDER BY distance, node_id LIMIT 5),
  both_ AS (SELECT node_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, similarity)) AS similarity, late, rank FROM found UNION ALL SELECT node_id, 0.5, 1, row_number() OVER (ORDER BY score DESC, node_id) FROM fts)
  SELECT node_id, CAST(similarity AS DOUBLE) AS similarity, CAST(late AS INTEGER) AS late, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY late, rank) AS nth FROM both_) WHERE nth = 1 ORDER BY late, rank LIMIT {K}"""
)
def knn_with_lazy_nodes(g: Graph) -> DataFrame:
    query = g.embeddings.filter("model_id = 'm1' AND node_id = 42").first().embedding
    found = knn.one(query, knn.space_vectors(g.nodes, g.embeddings, MODEL, "code"), 5)
    found = found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "node_id")))  # five rows
    lazy = fts.candidates(g.nodes, SEARCH).select("node_id", F.lit(0.5).alias("similarity"), "rank")
    return knn.merge(found, lazy, K)


@query(
    """SELECT node_id, model_id, round(list_sum(list_transform(list_slice(v, 1, 16), lambda x: x * x)), 6) AS part, round(list_extract(list_transform(list_slice(v, 1, 16), lambda x: x / sqrt(list_sum(list_transform(list_slice(v, 1, 16), lambda y: y * y)))), 1), 6) AS first
  FROM (SELECT node_id, model_id, embedding::DOUBLE[] AS v FROM node_embeddings)"""
)
def truncated_vectors(g: Graph) -> DataFrame:
    head = F.slice("embedding", 1, 16)
    return g.embeddings.select("node_id", "model_id", F.round(V.dot(head, head), 6).alias("part"), F.round(F.element_at(V.truncated(F.col("embedding"), 16), 1), 6).alias("first"))


@query("SELECT id, base64(encode(substr(signature, 1, 200))) AS b64, 'search_query: ' || signature AS asked FROM nodes")
def encoded_text(g: Graph) -> DataFrame:
    return g.nodes.select("id", V.base64(F.encode(F.substring("signature", 1, 200), "UTF-8")).alias("b64"), T.with_prefix("search_query: ", F.col("signature")).alias("asked"))


@query(
    """, w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(signature, '[^\\p{L}\\p{N}_]+'), lambda x: strlen(x) >= 4)) AS ws FROM nodes),
  r AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY strlen(w) DESC, w) AS k FROM (SELECT id, unnest(ws) AS w FROM w))
  SELECT n.id, coalesce(string_agg('"' || w || '"', ' OR ' ORDER BY k), '') AS expression FROM nodes n LEFT JOIN r ON r.id = n.id AND k <= 3 GROUP BY n.id"""
)
def match_expressions(g: Graph) -> DataFrame:
    return g.nodes.select("id", T.match_expression(T.search_terms(F.col("signature"))).alias("expression"))


@query("SELECT 'node_embeddings' AS name, count(*) AS columns, bool_or(column_name = 'text_hash') AS has_text_hash FROM (DESCRIBE SELECT * FROM node_embeddings)")
def schema_check(g: Graph) -> DataFrame:
    g.embeddings.createOrReplaceTempView("node_embeddings")
    found = g.embeddings.sparkSession.sql("DESCRIBE TABLE node_embeddings")
    return found.agg(F.lit("node_embeddings").alias("name"), F.count(F.lit(1)).alias("columns"), F.bool_or(F.col("col_name") == "text_hash").alias("has_text_hash"))


@query("SELECT count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS skipped FROM (SELECT id % 17 = 0 OR id % 19 = 0 AS bad FROM nodes)")
def readable_nodes(g: Graph) -> DataFrame:
    """Nodes, some of them without id or kind, that a reindex can work with, and the others."""
    broken = g.nodes.select(F.when(F.col("id") % 17 != 0, F.col("id")).alias("id"), F.when(F.col("id") % 19 != 0, F.col("kind")).alias("kind"))
    return broken.agg(F.count_if(P.decodable()).alias("good"), F.count_if(~P.decodable()).alias("skipped"))


@query("SELECT CAST(id AS VARCHAR) AS id, md5(signature) AS text_md5 FROM nodes")
def json_lines(g: Graph) -> DataFrame:
    lines = g.nodes.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("signature").alias("text"), "kind")).alias("value"))
    return parsed_lines(lines.unionByName(lines.limit(3).select(F.lit("  ").alias("value")))).select("id", F.md5("text").alias("text_md5"))


@query(
    """SELECT node_id, model_id, len(embedding) AS n, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squares, round(embedding[1]::DOUBLE, 6) AS cls,
  round((embedding[1]::DOUBLE + (node_id % 2) * embedding[17]::DOUBLE) / (1 + node_id % 2), 6) AS mean FROM (SELECT node_id, model_id, embedding FROM node_embeddings)"""
)
def packed_and_pooled_vectors(g: Graph) -> DataFrame:
    """Vectors as bytes and back (with a byte too many), and pooled: as two tokens of 16 values each, the second one masked for even ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            back = [V.unpacked(V.packed(v) + b"x") for v in pdf["embedding"]]
            hidden = np.array([v[:32] for v in back], np.float64).reshape(len(back), 2, 16)
            mask = np.stack((np.ones(len(pdf)), pdf["node_id"] % 2), 1)
            cls, mean = (V.pooled(hidden, mask, p)[:, 0].round(6) for p in ("cls", "mean"))
            squares = [round(float(np.dot(v.astype(np.float64), v)), 6) for v in back]
            yield pd.DataFrame({"node_id": pdf["node_id"], "model_id": pdf["model_id"], "n": [len(v) for v in back], "squares": squares, "cls": cls, "mean": mean})

    return g.embeddings.select("node_id", "model_id", "embedding").mapInPandas(run, "node_id long, model_id string, n long, squares double, cls double, mean double")


@query(
    """SELECT parallel, single, override, CAST(CASE WHEN override >= 0 THEN greatest(override, 512) ELSE least(greatest(8192 // (CASE WHEN single THEN 1 ELSE greatest(parallel, 1) END), 1024), 4096) END AS BIGINT) AS budget
  FROM (SELECT CAST(i % 12 AS BIGINT) AS parallel, i % 2 = 0 AS single, CAST(CASE WHEN i % 5 = 0 THEN i * 40 ELSE -1 END AS BIGINT) AS override FROM range(60) t(i))"""
)
def token_budgets(g: Graph) -> DataFrame:
    asked = [(i % 12, i % 2 == 0, i * 40 if i % 5 == 0 else -1) for i in range(60)]
    return g.nodes.sparkSession.createDataFrame([(p, s, o, batching.token_budget(p, s, o if o >= 0 else None)) for p, s, o in asked], "parallel long, single boolean, override long, budget long")


@query()
def fnv_hashes(g: Graph) -> DataFrame:
    return g.nodes.select("id", hashing.text_hash(F.col("embed_text")).alias("text_hash"))


@query()
def embedded_pending(g: Graph) -> DataFrame:
    todo = pending.pending(g.nodes, g.edges, g.embeddings, MODEL)
    return encoder.embed(todo, Descriptor(64, "mean", 2, family="hash"), MODEL, hash_fn=hashing.md5)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what is pending, with its text, in the order in which it would be embedded."""
    g = derived(spark, sf_dir)
    return pending.pending(g.nodes, g.edges, g.embeddings, MODEL).orderBy(*pending.serial_order())
