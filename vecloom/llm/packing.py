"""Compact binary forms: sorted 64-bit values, and blocks of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialise, slices, text_bytes, trim


_held: dict[str, object] = {}


def squeeze(data: bytes) -> bytes:
    if "out" not in _held:  # one of each for a worker; they take longer to make than a small blob to compress
        _held["out"] = zstandard.ZstdCompressor(level=1)
    return _held["out"].compress(data)


def swell(blob: bytes) -> bytes:
    if "in" not in _held:
        _held["in"] = zstandard.ZstdDecompressor()
    return _held["in"].decompress(blob)


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, first bytes first, compressed."""
    return squeeze(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def unplanes(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(swell(blob), np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences."""
    d = np.diff(keys, prepend=keys[:1])
    wide = bool(len(d)) and int(d.max()) >= 1 << 32
    first = int(keys[0]) if len(keys) else 0
    return bytes([wide]) + first.to_bytes(8, "little") + planes(d.astype("<u8" if wide else "<u4"))


def unpack(blob: bytes) -> np.ndarray:
    d = unplanes(blob[9:], "<u8" if blob[0] else "<u4").astype(np.uint64)
    return np.cumsum(d) + np.uint64(int.from_bytes(blob[1:9], "little"))


def blocks(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """Whole texts in blocks of about 1 MB (a longer text is a block of its own): block, ids, cuts, texts (compressed).

    With `rest`, also these columns of the rows, as an array of structs. Written to the shared folder, so that whatever
    refers to a block by its number meets the same rows after a retry.
    """
    cols = ["doc_id", "text"] if rest is None else ["doc_id", "text", *(c for c in rest if c not in ("doc_id", "text"))]
    others = cols[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            data, off = text_bytes(table.column("text"))
            made += 1
            columns = [pa.array([part << 32 | made - 1]), pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([off], pa.list_(pa.int64())), pa.array([squeeze(data.tobytes())], pa.binary())]
            if others:
                rows = pa.StructArray.from_arrays([table.column(c).chunk(0) for c in others], names=others)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows))
            return pa.record_batch(columns, names=["block", "ids", "cuts", "texts", *(["rest"] if others else [])])

        for batch in batches:
            for piece in slices(batch):
                n = pa.compute.sum(pa.compute.binary_length(piece.column("text"))).as_py() or 0
                if held and (size + n > SLICE_BYTES or len(held) > 64):
                    yield out()
                    held, size = [], 0
                held.append(piece)
                size += n
        if held:
            yield out()

    kinds = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in others)
    more = f", rest array<struct<{kinds}>>" if others else ""
    return materialise(docs.select(*(f"`{c}`" for c in cols)).mapInArrow(run, "block long, ids array<long>, cuts array<long>, texts binary" + more), "blocks")


def opened(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(block, ids, bytes, cuts) of each block."""
    for block, ids, cuts, texts in zip(*(batch.column(c) for c in ("block", "ids", "cuts", "texts")), strict=True):
        yield block.as_py(), ids.values, np.frombuffer(swell(texts.as_buffer()), np.uint8), cuts.values.to_numpy()
    trim()


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """One string a row: its words, joined by one space."""
    size = end - start + 1
    to = np.concatenate(([0], np.cumsum(size)))
    last = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(last)))
    stream = np.full(to[-1], 32, np.uint8)
    src = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
    inner = src < np.repeat(end, size)
    stream[inner] = data[src[inner]]
    keep = np.ones(len(stream), bool)
    full = last > 0
    keep[to[first[1:][full]] - 1] = False
    cut = to[first] - np.concatenate(([0], np.cumsum(full)))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(stream[keep].tobytes())).cast(pa.string())


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A bit for each upper `bits` bits of the values `a`."""
    size = min(bits, 20)

    def mark(group: pa.Table) -> pa.Table:
        seen = np.zeros(1 << size, bool)
        at = group.column("a").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        seen[(at & np.uint64((1 << size) - 1)).astype(np.int64)] = True
        return pa.table({"g": group.column("g")[:1], "bits": pa.array([squeeze(np.packbits(seen).tobytes())], pa.binary())})

    out = np.zeros((1 << bits - size, max(1, (1 << size) // 8)), np.uint8)
    g = F.shiftrightunsigned("a", 64 - bits + size).cast("int") if bits > size else F.lit(0)
    for k, b in values.select("a", g.alias("g")).distinct().groupBy("g").applyInArrow(mark, "g int, bits binary").toLocalIterator():
        out[k] = np.frombuffer(swell(b), np.uint8)
    return out.ravel()


def set_in(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether these bits of a bitmap are set."""
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _marked(docs: DataFrame, key: Column, listed: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame, str, str]:
    """docs with two more columns: a hash of key, and whether a bitmap of bounded size over `listed` has it; listed as such a hash; the columns' names."""
    taken, n_key, n_hit = {c.lower() for c in docs.columns}, "__key", "__hit"
    while taken & {n_key, n_hit}:
        n_key, n_hit = f"_{n_key}", f"_{n_hit}"
    name = listed.columns[0]
    n = listed.count()
    bits = int(np.ceil(np.log2(min(1 << most_bits, max(1 << 16, 32 * n)))))
    hashed = listed.select(F.xxhash64(name).alias(n_key))
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(hashed.select(F.col(n_key).alias("a")), bits))
    width = len(docs.columns)
    names = [*docs.columns, n_key, n_hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(width).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield pa.record_batch([*batch.columns, pa.array(set_in(seen.value, h))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(n_key, F.xxhash64(key)).mapInArrow(run, f"{fields}, {n_key} long, {n_hit} boolean"), hashed, n_key, n_hit


def without(docs: DataFrame, key: Column, gone: DataFrame, most_bits: int = 27) -> DataFrame:
    """The rows of docs whose `key` (long) is not in `gone` (one column of distinct longs).

    The bitmap passes most rows that stay at once; only the others are joined.
    """
    rows, hashed, n_key, hit = _marked(docs, key, gone, most_bits)
    left = rows.filter(~F.col(hit)).drop(n_key, hit)
    return left.unionByName(rows.filter(F.col(hit)).join(hashed, n_key, "left_anti").drop(n_key, hit))


def only(docs: DataFrame, key: Column, wanted: DataFrame, most_bits: int = 27) -> DataFrame:
    """The rows of docs whose `key` (long) is in `wanted`; of the others, only the few that the bitmap takes for them are shuffled."""
    rows, hashed, n_key, hit = _marked(docs, key, wanted, most_bits)
    return rows.filter(F.col(hit)).join(hashed.hint("merge"), n_key, "left_semi").drop(n_key, hit)
