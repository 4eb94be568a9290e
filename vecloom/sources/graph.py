"""The graph's four tables: read from a folder, or derived from the test tables by SQL that Spark and DuckDB both take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .. import schema

NODES_SQL = """SELECT doc_id AS id,
  CASE WHEN doc_id % 10 = 0 THEN 'file' WHEN doc_id % 10 = 1 THEN 'import' WHEN doc_id % 10 IN (2, 3, 4) THEN 'doc-chunk'
       WHEN doc_id % 10 = 5 THEN 'class' ELSE 'function' END AS kind,
  substr(text, 1, 80) AS signature,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 13 = 1 THEN concat('test/', source, '.rs')
       WHEN doc_id % 13 = 2 THEN concat(source, '/mod_TEST.rs') ELSE concat('src/', source, '.rs') END AS path,
  lang AS language,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars % 10 END AS shell_number,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS embed_text FROM documents"""
EDGES_SQL = """SELECT doc_id AS src, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS dst, 'ref' AS kind FROM documents
  UNION ALL SELECT doc_id, CAST(floor(doc_id / 10) AS BIGINT), 'call' FROM documents"""
TOMBSTONES_SQL = "SELECT event_id % (2 * (SELECT count(*) FROM documents)) AS node_id, ts AS deleted_at FROM events WHERE event_type = 'error'"
EMBEDDINGS_SQL = """SELECT e.node_id, e.model_id, e.embedding,
  CASE WHEN e.vec_id % 11 IN (0, 1, 2) THEN NULL WHEN e.vec_id % 11 IN (3, 4, 5) THEN md5(n.embed_text || '~old')
       ELSE md5(n.embed_text) END AS text_hash
  FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 8 THEN vec_id + 1000000 ELSE vec_id END AS node_id, 'm1' AS model_id, embedding FROM embeddings
        UNION ALL SELECT vec_id, vec_id, 'm2', embedding FROM embeddings WHERE vec_id % 6 = 0) e LEFT JOIN nodes n ON n.id = e.node_id"""

#: For SQL over the test tables: the four tables as common table expressions.
WITH = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL}), node_tombstones AS ({TOMBSTONES_SQL}), node_embeddings AS ({EMBEDDINGS_SQL})"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    tombstones: DataFrame
    embeddings: DataFrame


def derived(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over documents, embeddings and events of a test folder."""
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings", "events")}
    nodes = spark.sql(NODES_SQL.replace("FROM documents", "FROM {documents}"), documents=raw["documents"])
    edges = spark.sql(EDGES_SQL.replace("FROM documents", "FROM {documents}"), documents=raw["documents"])
    tombstones = spark.sql(TOMBSTONES_SQL.replace("FROM documents", "FROM {documents}").replace("FROM events", "FROM {events}"), documents=raw["documents"], events=raw["events"])
    embeddings = spark.sql(EMBEDDINGS_SQL.replace("FROM embeddings", "FROM {embeddings}").replace("JOIN nodes", "JOIN {nodes}"), embeddings=raw["embeddings"], nodes=nodes)
    return Graph(nodes, edges, tombstones, embeddings)


def read(spark: SparkSession, graph_dir: str) -> Graph:
    """The graph's tables in a folder; its vectors, if they are there and not in a store beside it."""
    at = lambda name: f"{graph_dir}/{name}"
    try:
        embeddings = schema.migrate(spark.read.parquet(at("node_embeddings")))
    except AnalysisException:
        embeddings = spark.createDataFrame([], schema.EMBEDDINGS)
    return Graph(
        spark.read.schema(schema.NODES).parquet(at("nodes")),
        spark.read.schema(schema.EDGES).parquet(at("edges")),
        spark.read.schema(schema.TOMBSTONES).parquet(at("node_tombstones")),
        embeddings,
    )
