"""Serving: a query's vector, its neighbours in a space, and nodes found by text where these fall short."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import encoder, fts, knn, pending
from ..schema import MEMO_SECONDS
from ..sources.descriptor import Descriptor
from ..sources.graph import Graph
from ..sources.store import Served, Store


class Memo:
    """The last query's vector, for MEMO_SECONDS, by its exact text."""

    def __init__(self, make: Callable[[str], list[float]], clock=time.monotonic, trace: Callable[[str], None] | None = None):
        self.make, self.clock, self.trace = make, clock, trace
        self.held: tuple[str, list[float], float] | None = None

    @staticmethod
    def fresh(age: float) -> bool:
        return age < MEMO_SECONDS

    def get(self, text: str, space: str = "code") -> list[float]:
        now = self.clock()
        hit = self.held is not None and self.held[0] == text and self.fresh(now - self.held[2])
        if not hit:
            self.held = (text, self.make(text), now)
        if self.trace:
            try:
                self.trace("\t".join(("QUERY_EMBED_CACHE", space, "hit" if hit else "miss", text)))
            except OSError:
                pass
        return self.held[1]


def appender(path: str) -> Callable[[str], None]:
    """Appends lines to a file; opened for each, so that it may be moved away meanwhile."""

    def append(line: str) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(line.replace("\n", " ") + "\n")

    return append


class Searcher:
    """trace: a file to which each query's fate in the memo is appended."""

    def __init__(self, store: Store, g: Graph, model_id: str, d: Descriptor, folder: str | None = None, trace: str | None = None):
        self.store, self.g, self.model_id, self.d, self.folder = store, g, model_id, d, folder
        self.encoder = encoder.worker_encoder(folder, d)
        self.memo = Memo(lambda t: self.encoder.embed_query(t).tolist(), trace=appender(trace) if trace else None)
        self.spaces = {s: Served(store, f"index-{model_id}-{s}") for s in ("code", "docs")}

    def knn(self, text: str, k: int, space: str = "code") -> list[tuple[int, float]]:
        """(node, similarity), nearest first. Of the code space, nodes without a vector are found by text where k is not reached."""
        query = self.memo.get(text, space)
        index = self.spaces[space].get()
        found = [] if index is None else [(r.node_id, r.similarity) for r in knn.one(query, index, k).collect()]
        if space == "code" and len(found) < k:
            seen = {i for i, _ in found}
            found += [x for x in self.lazy(text, query) if x[0] not in seen][: k - len(found)]
        return found

    def lazy(self, text: str, query: list[float]) -> list[tuple[int, float]]:
        """Candidates without a vector, in the order of their rank; their vectors are stored where none has come meanwhile."""
        wanting = pending.candidates(self.g.nodes, self.store.embeddings(), self.model_id)
        best = fts.candidates(wanting, text).cache()
        rows = pending.pending(self.g.nodes, self.g.edges, self.store.embeddings(), self.model_id, where=F.col("id").isin([r.node_id for r in best.collect()] or [None]))
        new = encoder.embed(rows, self.d, self.model_id, self.folder).cache()  # FTS_CANDIDATES rows at most
        if new.isEmpty():
            return []
        q = F.array(*(F.lit(float(x)) for x in query))
        scored = best.join(new, "node_id").select("node_id", "rank", V.similarity(1 - V.dot(q, F.col("embedding"))).alias("similarity")).orderBy("rank")
        out = [(r.node_id, r.similarity) for r in scored.collect()]
        self.store.put_embeddings(new, replace=False)
        return out

    def answer(self, text: str, k: int, space: str = "code") -> list[tuple[int, float]]:
        """knn(), but empty where it fails."""
        try:
            return self.knn(text, k, space)
        except Exception:
            return []


def answer_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """A table of query vectors (query_id, embedding) at once; equal queries are searched once each."""
    return knn.exact(queries.dropDuplicates(["query_id"]), vectors, k)
