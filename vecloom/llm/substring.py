"""Substring deduplication of whole corpora, with a count-min prefilter.

A window is `width` consecutive words of one text. Words under a window whose words also start in a text with a smaller
id are removed.

First pass: every block of texts counts its windows, each under its anchor, the least hash among the six-word runs in
it. Equal windows have equal anchors, so an anchor's count is no less than any of its windows', and a block has some
four times fewer of them. Each partition makes a sparse count-min sketch (two rows of cells); merged by ranges of
cells, these leave one bit a cell: counted twice or more. Second pass: only windows whose anchor's both bits are set go
into the exact grouping, under 128 bits of two independent hashes, of a block each once with its least id. What comes
back to a block are the windows that start in another block under a smaller id. Estimates only ever exceed counts,
so no repeated window is lost.

The sketch has four cells for each expected anchor but at most 2**CELL_BITS, so what is sent to the executors is at
most 2 * 2**CELL_BITS / 8 bytes (64 MB). Beyond some 70 million anchors the share of windows that pass it in vain
rises; the result stays exact.

Defined results: null and empty texts have no words; a null id counts as larger than all others and its rows stay
apart; of rows with equal ids none removes words of the other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hash_spans, mix, power_of_two, roll, total_bytes, within, words
from .packing import blocks, joined_words, opened, pack, planes, set_in, squeeze, swell, unpack, unplanes

WIDTH = 13
RUN = 6
CELL_BITS = 28
#: Cells that one group of the merge has, and anchors that a partition holds before it writes a sketch, as powers of two.
RANGE_BITS = 20
HELD = 1 << 22
#: Windows that an exact group has, about.
GROUP = 1 << 20

_LAST = np.iinfo(np.int64).max


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive words: the least hash of the RUN-word runs in them."""
    out = roll(h, RUN)
    have, want = 1, width - RUN + 1
    while have < want:
        step = min(have, want - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def cells(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return mix(anchor + np.uint64(1)) >> shift, mix(anchor ^ np.uint64(0xA24BAED4963EE407)) >> shift


def _sketch(texts: DataFrame, bits: int, width: int) -> np.ndarray:
    """A row of bits for each hash: cells counted twice or more."""
    size = min(RANGE_BITS, bits)
    ranges = 1 << bits - size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            for r, cell in enumerate(cells(np.concatenate(held), bits)):
                cell.sort()
                lead = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                twice = np.diff(np.append(lead, len(cell))) > 1
                key = cell[lead] << np.uint64(1) | twice.astype(np.uint64)
                cut = np.searchsorted(key, np.arange(1, ranges, dtype=np.uint64) << np.uint64(size + 1)).tolist()
                parts = [(g, a, b) for g, a, b in zip(range(ranges), [0, *cut], [*cut, len(key)], strict=True) if a < b]
                yield pa.record_batch([pa.array([r << 16 | g for g, _, _ in parts], pa.int32()), pa.array([pack(key[a:b] & np.uint64((1 << size + 1) - 1)) for _, a, b in parts], pa.binary())], names=["g", "keys"])

        for batch in batches:
            for _, _, data, cuts in opened(batch):
                start, end, row = words(data, cuts)
                a = anchors(hash_spans(data, start, end), width)[within(row, width)]
                if len(a):
                    held.append(a[np.concatenate(([True], a[1:] != a[:-1]))])
                if sum(map(len, held)) > HELD:
                    yield from out()
                    held.clear()
        if held:
            yield from out()

    def merge(group: pa.Table) -> pa.Table:
        counts = np.zeros(1 << size, np.uint8)
        for blob in group.column("keys"):
            key = unpack(blob.as_py())
            at = (key >> np.uint64(1)).astype(np.int64)
            counts[at] = np.minimum(counts[at] + 1 + (key & np.uint64(1)).astype(np.uint8), 2)
        return pa.table({"g": group.column("g")[:1], "bits": pa.array([squeeze(np.packbits(counts > 1).tobytes())], pa.binary())})

    out = np.zeros((2, ranges, max(1, (1 << size) // 8)), np.uint8)
    merged = texts.select("block", "ids", "cuts", "texts").mapInArrow(count, "g int, keys binary").groupBy("g").applyInArrow(merge, "g int, bits binary")
    for g, b in merged.toLocalIterator():
        out[g >> 16, g & 0xFFFF] = np.frombuffer(swell(b), np.uint8)
    return out.reshape(2, -1)


def _windows(data: np.ndarray, cuts: np.ndarray, width: int) -> tuple:
    start, end, row = words(data, cuts)
    h = hash_spans(data, start, end)
    ok = within(row, width)
    return start, end, row, h, ok, roll(h, width)[ok], roll(hash_spans(data, start, end, 1), width, 1)[ok]


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    texts = blocks(docs)
    size = total_bytes(docs)
    bits = int(np.log2(power_of_two(size / 27 * 4, 16, CELL_BITS)))
    seen = docs.sparkSession.sparkContext.broadcast(_sketch(texts, bits, width))
    groups = power_of_two(size / 24 / GROUP, 3, 20)
    shift = np.uint64(64 - int(np.log2(groups)))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, data, cuts in opened(batch):
                start, end, row = words(data, cuts)
                h = hash_spans(data, start, end)
                ok = within(row, width)
                hit = np.ones(int(ok.sum()), bool)
                for bit, cell in zip(seen.value, cells(anchors(h, width)[ok], bits), strict=True):
                    hit &= set_in(bit, cell)
                if not hit.any():
                    continue
                a, b = roll(h, width)[ok][hit], roll(hash_spans(data, start, end, 1), width, 1)[ok][hit]
                own = ids.fill_null(_LAST).to_numpy()[row[: len(ok)][ok][hit]]
                order = np.lexsort((own, b, a))
                a, b, own = a[order], b[order], own[order]
                lead = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                a, b, own = a[lead], b[lead], own[lead]
                cut = np.searchsorted(a >> shift, np.arange(groups + 1, dtype=np.uint64)).tolist()
                full = [g for g in range(groups) if cut[g] < cut[g + 1]]
                yield pa.record_batch(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([block] * len(full), pa.int64()),
                        pa.array([pack(a[cut[g] : cut[g + 1]]) for g in full], pa.binary()),
                        pa.array([planes(b[cut[g] : cut[g + 1]]) for g in full], pa.binary()),
                        pa.array([planes(own[cut[g] : cut[g + 1]]) for g in full], pa.binary()),
                    ],
                    names=["g", "block", "a", "b", "own"],
                )

    def settle(group: pa.Table) -> pa.Table:
        cols = [[unpack(x.as_py()) for x in group.column("a")], [unplanes(x.as_py(), "<u8") for x in group.column("b")], [unplanes(x.as_py(), "<i8") for x in group.column("own")]]
        at = np.repeat(np.arange(len(cols[0])), [len(x) for x in cols[0]])
        a, b, own = map(np.concatenate, cols)
        order = np.lexsort((own, b, a))
        a, b, own, at = a[order], b[order], own[order], at[order]
        lead = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least = own[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        later = own > least
        a, b, at = a[later], b[later], at[later]
        order = np.argsort(at, kind="stable")
        a, b, at = a[order], b[order], at[order]
        of, first = np.unique(at, return_index=True)
        ends = np.append(first[1:], len(at))
        block = group.column("block").to_numpy()
        return pa.table(
            {
                "block": pa.array(block[of], pa.int64()),
                "a": pa.array([pack(a[i:j]) for i, j in zip(first, ends, strict=True)], pa.binary()),
                "b": pa.array([planes(b[i:j]) for i, j in zip(first, ends, strict=True)], pa.binary()),
            }
        )

    def remove(block: pa.Table, found: pa.Table) -> pa.Table:
        outs = []
        for _, ids, data, cuts in opened(block):
            start, end, row, _, ok, a, b = _windows(data, cuts, width)
            n = len(ids)
            own = ids.fill_null(_LAST).to_numpy()[row[: len(ok)][ok]]
            order = np.lexsort((own, b, a))
            lead = np.ones(len(order), bool)
            lead[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            least = np.empty(len(order), np.int64)
            least[order] = own[order][np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(order) else own
            gone = own > least
            if found.num_rows:
                fa = np.concatenate([unpack(x.as_py()) for x in found.column("a")])
                fb = np.concatenate([unplanes(x.as_py(), "<u8") for x in found.column("b")])
                by = np.lexsort((fb, fa))
                fa, fb = fa[by], fb[by]
                at = np.searchsorted(fa, a)
                while True:  # equal first halves are as good as never more than one
                    inside = at < len(fa)
                    same = np.zeros(len(a), bool)
                    same[inside] = fa[at[inside]] == a[inside]
                    if not same.any():
                        break
                    gone[same] |= fb[at[same]] == b[same]
                    at = np.where(same, at + 1, len(fa))
            delta = np.zeros(len(start) + 1, np.int32)
            hit = np.flatnonzero(ok)[gone]
            delta[hit] += 1
            np.subtract.at(delta, hit + width, 1)
            keep = np.cumsum(delta)[:-1] == 0
            count = np.bincount(row, minlength=n)
            left = np.bincount(row[keep], minlength=n)
            outs.append(pa.table({"doc_id": ids, "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(count - left, pa.int64()), "kept": joined_words(data, start[keep], end[keep], row[keep], n)}))
        return pa.concat_tables(outs) if outs else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    found = texts.mapInArrow(offer, "g int, block long, a binary, b binary, own binary").groupBy("g").applyInArrow(settle, "block long, a binary, b binary")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
