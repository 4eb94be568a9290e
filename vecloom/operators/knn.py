"""Nearest neighbours by cosine: exact, or through an inverted file; merged with lazily found nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.predicates import in_space

#: Queries that are sent to the executors as one matrix; more are answered in turns.
QUERY_BLOCK = 4096
#: Vectors that are scored at once.
VECTOR_BLOCK = 1024


def space_vectors(nodes: DataFrame, embeddings: DataFrame, model_id: str, space: str) -> DataFrame:
    """node_id, embedding of one model's vectors in the code or docs space."""
    ids = nodes.filter(in_space(space)).select(F.col("id").alias("node_id"))
    return embeddings.filter(F.col("model_id") == model_id).join(ids, "node_id").select("node_id", "embedding")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of each query_id with the least distance (ties by node_id), with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(d: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least distances and their nodes; ties go by node. Not in order."""
    if d.shape[1] <= k:
        return d, node
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    sure, tied = d < edge, d == edge
    room = k - sure.sum(1)
    for i in np.flatnonzero(tied.sum(1) > room):
        at = np.flatnonzero(tied[i])
        tied[i] = False
        tied[i, at[np.argsort(node[i, at], kind="stable")[: room[i]]]] = True
    take = np.nonzero(sure | tied)
    return d[take].reshape(len(d), k), node[take].reshape(len(d), k)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of QUERY_BLOCK queries at a time; one empty block where there are none."""
    block, any_yet = [], False
    for row in queries.select("query_id", "embedding").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
            block, any_yet = [], True
    if block or not any_yet:
        yield np.array([r[0] for r in block], np.int64), (np.array([r[1] for r in block], np.float64) if block else np.zeros((0, 0)))


def _all(parts: Iterator[DataFrame]) -> DataFrame:
    out = next(parts)
    for p in parts:
        out = out.unionByName(p)
    return out


def _score(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Each task keeps k rows a query, so what is shuffled doesn't grow with the number of vectors."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best_d, best_id = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
        for batch in batches if len(q) else ():
            for i in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(i, VECTOR_BLOCK)
                d = np.round(1 - q @ _matrix(part.column("embedding")).T, 6) + 0.0  # no negative zero
                node = np.broadcast_to(part.column("node_id").to_numpy(), d.shape)
                d, node = _best(d, node, k)
                best_d, best_id = _best(np.concatenate((best_d, d), 1), np.concatenate((best_id, node), 1), k)
        n = best_d.shape[1]
        yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(best_id.ravel()), pa.array(best_d.ravel())], names=["query_id", "node_id", "distance"])

    return rows.select("node_id", "embedding").mapInArrow(run, "query_id long, node_id long, distance double")


def exact(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, node_id, distance, similarity, rank. Queries (query_id, embedding) are taken to the driver block by block."""
    out = _all(_score(vectors, ids, q, k) for ids, q in _blocks(queries))
    return top(out, k).select("query_id", "node_id", "distance", V.similarity(F.col("distance")).alias("similarity"), "rank")


def one(query: list[float], vectors: DataFrame, k: int) -> DataFrame:
    """The same for a single query, by Spark's own functions: node_id, distance, similarity, in order."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("node_id", F.round(1 - V.dot(q, F.col("embedding")), 6).alias("distance"))
    return scored.orderBy("distance", "node_id").limit(k).withColumn("similarity", V.similarity(F.col("distance")))


class InvertedFile:
    """Approximate search: cells around centroids fitted on a bounded sample; every vector is in its nearest cell.

    A search looks at the `probe` nearest cells of each query. Written partitioned by cell, a search reads only these.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int = 32, sample: int = 20_000, rounds: int = 12, seed: int = 3) -> InvertedFile:
        """k-means on `sample` vectors at most, the first by a hash of their id."""
        rows = vectors.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(sample).select("embedding").collect()
        x = V.unit(np.array([r[0] for r in rows], np.float64))
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((1, 1))
        for _ in range(rounds if len(x) else 0):
            own = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, V.unit(sums), c)
        return cls(c)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """Adds `cell` to each vector."""
        shared = vectors.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = (_matrix(b.column("embedding")) @ shared.value.T).argmax(1) if b.num_rows else np.zeros(0, np.int64)
                yield pa.record_batch([b.column("node_id"), b.column("embedding"), pa.array(cell.astype(np.int32))], names=["node_id", "embedding", "cell"])

        return vectors.select("node_id", "embedding").mapInArrow(run, "node_id long, embedding array<float>, cell int")

    def search(self, queries: DataFrame, indexed: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """As exact(), over the probed cells, five eighths of all by default. Each vector meets only the queries that probe its cell."""
        probe = probe or -(-len(self.centroids) * 5 // 8)
        found = _all(self._probed(ids, q, indexed, k, probe) for ids, q in _blocks(queries))
        return top(found, k).select("query_id", "node_id", "distance", V.similarity(F.col("distance")).alias("similarity"), "rank")

    def _probed(self, ids: np.ndarray, q: np.ndarray, indexed: DataFrame, k: int, probe: int) -> DataFrame:
        near = np.argsort(-(q @ self.centroids.T), axis=1)[:, :probe] if len(q) else np.zeros((0, probe), np.int64)
        by_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = indexed.sparkSession.sparkContext.broadcast((ids, q, by_cell))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, by_cell = shared.value
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # k rows a query and cell in a task
            for whole in batches:
                for i in range(0, whole.num_rows, VECTOR_BLOCK):
                    b = whole.slice(i, VECTOR_BLOCK)
                    cell, node, x = b.column("cell").to_numpy(), b.column("node_id").to_numpy(), _matrix(b.column("embedding"))
                    for c in np.unique(cell).tolist():
                        mine, ask = np.flatnonzero(cell == c), by_cell[c]
                        d = np.round(1 - q[ask] @ x[mine].T, 6) + 0.0  # no negative zero
                        d, n = _best(d, np.broadcast_to(node[mine], d.shape), k)
                        if c in held:
                            d, n = _best(np.concatenate((held[c][0], d), 1), np.concatenate((held[c][1], n), 1), k)
                        held[c] = d, n
            for c, (d, n) in held.items():
                yield pa.record_batch([pa.array(np.repeat(ids[by_cell[c]], d.shape[1])), pa.array(n.ravel()), pa.array(d.ravel())], names=["query_id", "node_id", "distance"])

        return indexed.filter(F.col("cell").isin(*by_cell)).mapInArrow(run, "query_id long, node_id long, distance double")


def merge(found: DataFrame, lazy: DataFrame, k: int) -> DataFrame:
    """found first, then lazy nodes not seen, up to k; both: node_id, similarity, rank."""
    both = found.select("node_id", "similarity", F.lit(0).alias("late"), "rank").unionByName(lazy.select("node_id", "similarity", F.lit(1).alias("late"), "rank"))
    once = both.withColumn("nth", F.row_number().over(Window.partitionBy("node_id").orderBy("late", "rank"))).filter("nth = 1")
    return once.orderBy("late", "rank").limit(k).select("node_id", "similarity", "late", "rank")
