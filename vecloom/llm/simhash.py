"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is 1 where it is 1 in over half the XXH64 values (seed 42) of the text's word shingles. Texts link
where their fingerprints differ in at most `radius` bits. Each distinct fingerprint emits all its variants within half
the radius; two that differ in at most `radius` bits have a variant in common. So far the method.

What is shuffled is not the 64-bit variant but `log2(variants) + 7` bits of its hash, sorted, as differences, with the
place of the fingerprint in its chunk: about 3.5 bytes a variant. Few unequal variants fall together so; what does is
checked against the fingerprints. All that collide are paired with the first of them, each such pair once, and verified:
as all that truly share a variant are within the radius, a dense group makes no more pairs than it has variants. Where
a pair out of more than two that collide fails, these few are gone through again with their true variants.

Defined results: null is the empty text; a text without words has fingerprint zero and links like any other; copies and
repeated rows share fingerprint and component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, majority, materialise, mix, power_of_two, slices, text_bytes, trim, words
from .components import components
from .packing import bitmap, pack, set_in, unpack, without

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a chunk as a power of two: 2**11 have 4.3 million variants.
CHUNK_BITS = 11
#: Bytes of text that are cut in shingles at once.
PART_BYTES = 1 << 18
#: Fingerprints whose variants are hashed at once.
MIXED = 64
#: Variants of a reduce group, about.
GROUP = 1 << 20
#: Bits of a variant's hash beyond the logarithm of their number.
SPARE_BITS = 7
#: Bits, as a power of two, of the bitmap of collisions that are gone through again.
TORN_BITS = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    import xxhash

    data, off = text_bytes(column)
    data = _LOWER[data]
    start, end, row = words(data, off)
    n = len(column)
    out = np.zeros(n, np.uint64)
    if not len(start):
        return out
    size = end - start + 1
    to = np.concatenate(([0], np.cumsum(size)))
    stream = np.full(to[-1], 32, np.uint8)
    at = np.arange(to[-1])
    own = np.repeat(np.arange(len(start)), size)
    src = start[own] + at - to[own]
    inner = src < end[own]
    stream[inner] = data[src[inner]]
    text = stream.tobytes()
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    has = np.flatnonzero(shingles)
    doc = np.repeat(has, shingles[has])
    base = np.concatenate(([0], np.cumsum(shingles[has])))
    w = np.arange(base[-1]) - np.repeat(base[:-1], shingles[has]) + first[doc]
    a = to[w]
    b = to[np.minimum(w + shingle, first[doc] + count[doc])] - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[i:j], SEED) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    out[has] = majority(h, shingles[has])
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns and fp (long) of every row."""
    width = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                fp = fingerprints_of(part.column("text"), shingle).view(np.int64)
                yield pa.record_batch([*part.columns[:width], pa.array(fp)], names=[*cols, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.select(*cols, "text").mapInArrow(run, f"{kinds}, fp long")


def masks(radius: int) -> np.ndarray:
    """All 64-bit values with at most `radius` bits."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(64), k)], np.uint64)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    held: list[np.ndarray] = []
    n = 0

    def rows(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n, made
        size = 1 << CHUNK_BITS
        if n >= size or last and n:
            fp = np.concatenate(held)
            stop = n if last else n // size * size
            for i in range(0, stop, size):
                yield pa.record_batch([pa.array([part << 32 | made]), pa.array([fp[i : min(i + size, stop)]], pa.list_(pa.int64()))], names=["chunk", "fps"])
                made += 1
            held, n = [fp[stop:]], n - stop

    for batch in batches:
        held.append(batch.column("fp").to_numpy())
        n += batch.num_rows
        yield from rows(False)
    yield from rows(True)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From distinct values `fp`: pairs (a, b) of fingerprints within the radius, enough to connect all that are."""
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius has to be even")
    ball = masks(half)
    chunks = materialise(distinct.select("fp").mapInArrow(_chunked, "chunk long, fps array<long>"), "chunks")
    n_chunks, n = chunks.agg(F.count(F.lit(1)), F.sum(F.size("fps"))).first()
    variants = (n or 0) * len(ball)
    bits = int(np.clip(np.ceil(np.log2(max(2, variants))) + SPARE_BITS, 20, 64 - CHUNK_BITS))
    groups = power_of_two(variants / GROUP, 3, 20)
    low = bits - int(np.log2(groups)) + CHUNK_BITS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, fps in zip(batch.column("chunk").to_pylist(), batch.column("fps"), strict=True):
                fp = fps.values.to_numpy().view(np.uint64)
                place = np.arange(len(fp), dtype=np.uint64)[:, None]
                key = np.empty((len(fp), len(ball)), np.uint64)
                for i in range(0, len(fp), MIXED):  # what is in between stays small
                    key[i : i + MIXED] = mix(fp[i : i + MIXED, None] ^ ball) >> np.uint64(64 - bits) << np.uint64(CHUNK_BITS) | place[i : i + MIXED]
                key = key.ravel()
                key.sort()
                cut = np.searchsorted(key, np.arange(groups + 1, dtype=np.uint64) << np.uint64(low)).tolist()
                cut[-1] = len(key)
                full = [g for g in range(groups) if cut[g] < cut[g + 1]]
                for i in range(0, len(full), 64):
                    some = full[i : i + 64]
                    yield pa.record_batch([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([pack(key[cut[g] : cut[g + 1]]) for g in some], pa.binary())], names=["g", "chunk", "keys"])
                del key
                trim()

    def meet(group: pa.Table) -> pa.Table:
        out = stars_of(group)
        trim()
        return out

    def stars_of(group: pa.Table) -> pa.Table:
        keys, own = [], []
        chunk = group.column("chunk").to_numpy()
        for i, blob in enumerate(group.column("keys")):
            keys.append(unpack(blob.as_buffer().to_pybytes()))
            own.append(np.full(len(keys[-1]), i, np.int32))
        key, own = np.concatenate(keys), np.concatenate(own)
        h = key >> np.uint64(CHUNK_BITS)
        order = np.argsort(h, kind="stable")
        h = h[order]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        index, h = order[twin], h[twin]
        # a fingerprint is known by its chunk and its place there
        c, s = chunk[own[index]], (key[index] & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)
        by = np.lexsort((s, c, h))
        c, s, h = c[by], s[by], h[by]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(lead, len(h)))
        first = np.repeat(lead, size)
        other = np.arange(len(h)) > first
        star = np.stack([c[first], s[first], c, s, np.repeat(size > 2, size)], 1)[other]
        star = np.unique(star, axis=0) if len(star) else star
        return pa.table({"c1": star[:, 0], "s1": star[:, 1].astype(np.int32), "c2": star[:, 2], "s2": star[:, 3].astype(np.int32), "many": star[:, 4] > 0})

    def clash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(x).to_numpy().view(np.uint64) for x in "ab"), strict=True):
                both = np.intersect1d(*(mix(v ^ ball) >> np.uint64(64 - bits) for v in (a, b)))
                yield pa.record_batch([pa.array((both << np.uint64(64 - bits)).view(np.int64))], names=["a"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps in batch.column("fps"):
                fp = fps.values.to_numpy().view(np.uint64)
                v = (fp[:, None] ^ ball).ravel()
                h = mix(v) >> np.uint64(64 - bits) << np.uint64(64 - bits)
                hit = np.flatnonzero(set_in(torn.value, h >> np.uint64(64 - TORN_BITS)))
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in (h[hit], v[hit], fp[hit // len(ball)])], names=["a", "v", "fp"])

    spread_out = chunks.repartition(max(1, min(n_chunks or 1, 100_000))).mapInArrow(spread, "g int, chunk long, keys binary")
    met = materialise(spread_out.groupBy("g").applyInArrow(meet, "c1 long, s1 int, c2 long, s2 int, many boolean"), "met")
    by_place = chunks.select("chunk", F.posexplode("fps").alias("src", "fp"))
    one = by_place.select(F.col("chunk").alias("c1"), F.col("src").alias("s1"), F.col("fp").alias("a"))
    two = by_place.select(F.col("chunk").alias("c2"), F.col("src").alias("s2"), F.col("fp").alias("b"))
    pairs = met.groupBy("c1", "s1", "c2", "s2").agg(F.max("many").alias("many")).join(one, ["c1", "s1"]).join(two, ["c2", "s2"])
    pairs = materialise(pairs.select("a", "b", "many", (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).alias("near")), "pairs")
    near = pairs.filter("near AND a <> b").select("a", "b")
    runs = materialise(pairs.filter("many AND NOT near").select("a", "b").mapInArrow(clash, "a long").distinct(), "runs")
    if runs.isEmpty():
        return near
    torn = distinct.sparkSession.sparkContext.broadcast(bitmap(runs, TORN_BITS))
    shared = materialise(chunks.select("fps").repartition(max(1, min(n_chunks, 100_000))).mapInArrow(again, "a long, v long, fp long").join(runs, "a", "left_semi").select("v", "fp"), "shared")
    star = shared.groupBy("v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = shared.join(star.drop("n"), "v").select(F.col("fp").alias("a"), "b").filter("a <> b")
    return near.unionByName(stars).distinct()


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """fp, component (a fingerprint of the group) of each distinct fingerprint."""
    distinct = materialise(fps.select("fp").distinct(), "distinct")
    of = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    return materialise(distinct.join(of, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")), "grouped")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links, the own included) of every row."""
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    of = materialise(firsts.join(_grouped(fps, radius), "fp"), "of")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    named = materialise(join_hot(of, least, ["component"], "fps").select("fp", "n", "component_id"), "named")
    return join_hot(fps, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id (nulls last; then by a hash of the text).

    Of rows equal in both, the one whose other columns have the least hash.
    """
    row = F.xxhash64("doc_id", "text")
    fps = materialise(fingerprints(docs.select("doc_id", "text", row.alias("row")), shingle, ("doc_id", "row")), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = fps.groupBy("fp").agg(F.min(place).alias("first")).join(_grouped(fps, radius), "fp")
    kept = firsts.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    counted = materialise(fps.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "rows")
    gone = materialise(counted.join(kept, "row", "left_anti").select("row"), "gone")
    # rows equal in id and text: the one that stays is written once
    twice = materialise(counted.filter("n > 1").join(kept, "row", "left_semi").select("row"), "twice")
    left = without(docs, row, gone)
    if twice.isEmpty():
        return left
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    same = left.join(twice, row == twice["row"], "left_semi").select("doc_id", "text", every.alias("all"))
    again = same.groupBy("doc_id", "text").agg(F.min_by("all", F.xxhash64(F.to_json("all"))).alias("all")).select("all.*")
    return without(left, row, twice).unionByName(again)
