"""Fuzzy line deduplication.

A line is normalised to its words: lower-cased runs of letters and digits, every digit as 0; characters of scripts
without spaces are words of their own. Equal normalised lines of any length are one node. Nodes link where they share a
key (below) and their edit similarity (1 - Levenshtein / longer length, of the normalised lines) is at least
`similarity`. Of each connected group the first occurrence (by doc_id, then place) stays, all others go. Lines without
words stay.

A line's features are its different words (of words over LONG bytes, pieces). Its SimHash has 64 bits for each block of
features: a feature's hash says in which block it votes, and a line of n features has the power of two of blocks that
leaves 4 to 8 in each. So an edit of a word changes two blocks at most, and by the pigeonhole principle all others stay
equal: a line's keys are its blocks (one of less than MIN_VOTES features together with the next). A line that is near
the edge of its number of blocks has the keys of both. Below SMALL features, each feature is its block, and the keys
are all choices of all blocks but one, and all; below FEW, the blocks are characters. So any one word may differ, be
missing or be new; how many more depends on the blocks that are left (README has the recall).

A group of lines with a common key is not written out as pairs. First each line meets the first one in it that is near
by its whole SimHash and length, or else the first such after it, so that each line with any near one is in a pair; the
pairs' texts are fetched, verified and connected. Then, in groups of three and more near lines, those in different
components meet; these pairs are verified too and connect components.

Defined results: null and empty texts have one empty line, which stays; a text may end up empty; lines are cut at \\n
only; a null id comes last in the order; rows with equal ids are different texts; other columns pass unchanged, but
n_chars, where there is one, is the new text's length; an empty table gives no rows; doc_id has to be a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_counts, hash_runs, hash_spans, hash_without, join_hot, majority, materialise, mix, most_bits, power_of_two, runs, spans, text_bytes
from .components import components
from .packing import bitmap, blocks, joined_words, opened, pack, planes, set_in, unpack, unplanes

SIMILARITY = 0.8
#: Differing bits, of 64, up to which lines of a common key are verified; lines of less than SMALL features always are.
RADIUS = 16
#: Features below which the keys are all words but one.
SMALL = 16
#: Features that a key has at least, but for lines that have less.
MIN_VOTES = 3
#: Bytes of the longest word that is one feature, and of a longer one's pieces.
LONG = 24
PIECE = 8
#: Most bits of the bitmap that finds the candidates' texts, keys of a group, and lines numbered at once, as powers of two.
BITMAP_BITS = 27
GROUP_BITS = 18
LINE_BITS = 20
#: Bits of a feature.
VALUE_BITS = 44

_LAST = np.iinfo(np.int64).max
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_WORD = np.zeros(256, bool)
_WORD[[ord("0"), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_U = np.uint64
#: The first k bytes of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Fixed values of XXH64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def split_lines(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each line, with the end of all as a last entry, and the lines' texts. A text has at least one line."""
    breaks = np.flatnonzero(data == 10) + 1
    order = np.concatenate((cuts[:-1], breaks))
    row = np.concatenate((np.arange(len(cuts) - 1), np.searchsorted(cuts, breaks - 1, side="right") - 1))
    by = np.lexsort((order, row))
    return np.append(order[by], len(data)), row[by]


def _word_mask(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are of words, and where characters that are words of their own begin and end.

    Separators beyond ASCII: U+2000 to U+207F, U+3000 to U+303F, U+FF00 to U+FF0F. Words of their own: U+0E00 to U+0EFF,
    U+1000 to U+10BF, U+1780 to U+17FF, and from U+3040 on but for the separators.
    """
    inside = _WORD[low]
    lead = np.flatnonzero(low >= 0xE0)
    lead = lead[lead + 2 < len(low)]
    if not len(lead):
        return inside, lead
    x, y, z = low[lead], low[lead + 1], low[lead + 2]
    gap = (x == 0xE2) & ((y == 0x80) | (y == 0x81)) | (x == 0xE3) & (y == 0x80) | (x == 0xEF) & (y == 0xBC) & (z < 0x90)
    for k in range(3):
        inside[lead[gap] + k] = False
    own = ~gap & ((x >= 0xE3) | (x == 0xE0) & (y >= 0xB8) & (y < 0xBC) | (x == 0xE1) & ((y < 0x83) | (y == 0x9E) | (y == 0x9F)))
    at = lead[own]
    return inside, np.concatenate((at, at + np.where(low[at] >= 0xF0, 4, 3)))


def normalised(data: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes; the words' start, end and line; the first word of each line and the end."""
    text = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data.tobytes()))
    low, off = text_bytes(pa.compute.utf8_lower(text))
    low = _FOLD[low]
    breaks = np.flatnonzero(low == 10) + 1
    edges = np.sort(np.concatenate((off[:-1], breaks, [len(low)])), kind="stable")
    inside, more = _word_mask(low)
    start, end = runs(inside, np.concatenate((edges, more)))
    first = np.searchsorted(start, edges)
    return low, start, end, np.repeat(np.arange(len(edges) - 1), np.diff(first)), first


def hash_words(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its pieces of eight bytes are mixed in one after the other; words of over LONG bytes go by hash_spans()."""
    size = end - start
    eight = np.ndarray(len(low) + 1, "<u8", np.concatenate((low, np.zeros(8, np.uint8))), strides=1)  # the eight bytes from each place on
    h = mix((size.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) ^ eight[start] & _KEEP[np.minimum(size, 8)])
    for k in range(8, LONG, 8):
        more = np.flatnonzero(size > k)
        h[more] = mix(h[more] * _U(0xD1342543DE82EF95) ^ eight[start[more] + k] & _KEEP[np.minimum(size[more] - k, 8)])
    long = np.flatnonzero(size > LONG)
    if len(long):
        cut = np.concatenate(([0], np.cumsum(size[long])))
        h[long] = mix(hash_spans(low[np.repeat(start[long] - cut[:-1], size[long]) + np.arange(cut[-1])], cut[:-1], cut[1:]))
    return h


def features(low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, stop: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different features of each line (words first to stop, one at least), as sorted numbers of VALUE_BITS, by line, and how many there are.

    h: the words' hashes, whose upper bits are those of a word's feature.
    """
    n = end - start
    pieces = np.where(n > LONG, -(-n // PIECE), 1)
    at = np.concatenate(([0], np.cumsum(pieces)))
    if at[-1] > len(n):
        own = np.repeat(np.arange(len(n)), pieces)
        cut = np.flatnonzero(pieces[own] > 1)
        a = start[own[cut]] + (cut - at[own[cut]]) * PIECE
        h = h[own]
        h[cut] = hash_words(low, a, np.minimum(a + PIECE, end[own[cut]]))
    h = h >> _U(64 - VALUE_BITS)
    out, counts = [], []
    for i in range(0, len(first), 1 << LINE_BITS):
        lo, hi = at[first[i : i + (1 << LINE_BITS)]], at[stop[i : i + (1 << LINE_BITS)]]
        size = hi - lo
        to = np.concatenate(([0], np.cumsum(size)))
        both = np.repeat(np.arange(len(size), dtype=_U) << _U(VALUE_BITS), size) | h[np.repeat(lo - to[:-1], size) + np.arange(to[-1])]
        both.sort()
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        out.append(both & _U((1 << VALUE_BITS) - 1))
        counts.append(np.bincount((both >> _U(VALUE_BITS)).astype(np.int64), minlength=len(size)))
    return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, _U), np.zeros(0, np.int64))


def _classes(size: np.ndarray) -> np.ndarray:
    """The logarithm of the number of blocks; 0 below SMALL."""
    return np.where(size < SMALL, 0, np.floor(np.log2(np.maximum(size, 1) / 4 + 1e-9))).astype(np.int64)


def _block_keys(value: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and lines of lines of `size` features, each cut in 2**c blocks; SimHash of each line. A value's upper bits are its block, its mix() is its votes."""
    line = np.repeat(np.arange(len(size)), size)
    block = value >> np.repeat(VALUE_BITS - c, size).astype(_U)
    lead = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (line[1:] != line[:-1]))))
    votes = np.diff(np.append(lead, len(value)))
    counts = bit_counts(mix(value), votes)
    sim = most_bits(counts, votes)
    of = line[lead]
    begin = np.searchsorted(of, np.arange(len(size)))
    whole = np.zeros(len(size), _U)
    small = size < 256  # eight counters of eight bits are added at once
    if counts.dtype == np.uint8 and small.any():
        whole[small] = most_bits(np.add.reduceat(counts.view("<u8"), begin, axis=0)[small].view(np.uint8), size[small])
    else:
        small[:] = False
    if not small.all():
        whole[~small] = majority(mix(value[np.repeat(~small, size)]), size[~small])
    after = np.arange(len(lead)) + 1
    last = np.append(begin[1:], len(lead))[of]
    after = np.where(after == last, begin[of], after)
    key = sim.copy()
    thin = votes < MIN_VOTES
    key[thin] = mix(sim[thin] + mix(sim[after[thin]]))
    return mix(key ^ mix(block[lead] + (c[of].astype(_U) << _U(48)))), of, whole


def _hole_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of normalised lines: of the whole line, without each word, and of long words without each character.

    A word of over 1 - SIMILARITY of the line is long; one of over half as much again is not left out whole.
    """
    data, off = text_bytes(text)
    head = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters before each byte
    start, end, row = spans(data != 32, off)
    most = ((head[off[1:]] - head[off[:-1]]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    last = end == off[1:][row]
    first = start == off[:-1][row]
    size = head[end] - head[start] + 1
    fits = (2 * size <= 3 * most[row]) & ~(first & last)
    hole = np.where(last, start - 1, start)[fits]  # with the space after it, the last one with that before
    after = np.where(last, end, end + 1)[fits]
    whose = row[fits]
    long = size > most[row]
    one = np.flatnonzero(spans_mask(start[long], end[long], len(data)) & ((data & 0xC0) != 0x80))
    stop = np.flatnonzero((data & 0xC0) != 0x80)
    stop = np.append(stop, len(data))[np.searchsorted(stop, one) + 1]
    of = np.searchsorted(off, one, side="right") - 1
    ok = most[of] >= 1
    hole, after, whose = np.concatenate((hole, one[ok])), np.concatenate((after, stop[ok])), np.concatenate((whose, of[ok]))
    key = hash_without(data, off[:-1][whose], off[1:][whose], hole, after)
    return mix(np.concatenate((hash_spans(data, off[:-1], off[1:]), key)) ^ _U(7)), np.concatenate((np.arange(len(text)), whose))


def spans_mask(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places is in one of the spans, which do not overlap."""
    step = np.zeros(n + 1, np.int8)
    step[start] += 1
    np.subtract.at(step, end, 1)
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def keys_of(low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, stop: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and their lines; of each line whether it has SMALL features or more, and the SimHash if so. h: the words' hash_words()."""
    value, size = features(low, start, end, first, stop, hash_words(low, start, end) if h is None else h)
    if not len(size):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool)
    to = np.concatenate(([0], np.cumsum(size)))
    keys, lines = [], []
    sim = np.zeros(len(size), _U)
    own, near = _classes(size), _classes(np.ceil(size * SIMILARITY).astype(np.int64))
    for c, which in ((own, np.flatnonzero(own > 0)), (near, np.flatnonzero((near > 0) & (near != own)))):
        if len(which):
            n = size[which]
            cut = np.concatenate(([0], np.cumsum(n)))
            k, at, sim[which] = _block_keys(value[np.repeat(to[which] - cut[:-1], n) + np.arange(cut[-1])], n, c[which])
            keys.append(k)
            lines.append(which[at])
    few = np.flatnonzero((own == 0) | (near == 0))
    n = stop[few] - first[few]
    cut = np.concatenate(([0], np.cumsum(n)))
    w = np.repeat(first[few] - cut[:-1], n) + np.arange(cut[-1])
    k, at = _hole_keys(joined_words(low, start[w], end[w], np.repeat(np.arange(len(few)), n), len(few)))
    return np.concatenate((*keys, k)), np.concatenate((*lines, few[at])), sim, size >= SMALL


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance; columns of bits in Python's long integers. Where it is over `most`, any number over it."""
    n = min(len(a), len(b))
    lo = next((i for i in range(0, n, 64) if a[i : i + 64] != b[i : i + 64]), n)
    lo = next((i for i in range(lo, n) if a[i] != b[i]), n)
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    hi = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    spare = (len(a) + len(b) if most is None else most) + len(b)
    for i, c in enumerate(b):
        if score + i > spare:  # each column left takes off one at most
            return score + i - len(b)
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up ^ up) | x) & full
        ph, mh = down | (d | up) ^ full, up & d
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        up, down = mh << 1 & full | (x | ph) ^ full, ph & x
    return score


def edit_bound(a: str, b: str, reach: int = 8) -> int:
    """No less than the Levenshtein distance: the words' places are walked along, what differs is replaced up to the next equal words."""
    s, t = a.split(" "), b.split(" ")
    n, m = len(s), len(t)
    i = j = cost = 0
    while i < n and j < m:
        if s[i] == t[j]:
            i, j = i + 1, j + 1
            continue
        x, y = next(((x, k - x) for k in range(1, reach + 1) for x in range(k + 1) if i + x < n and j + k - x < m and s[i + x] == t[j + k - x]), (n - i, m - j))
        cost += max(sum(map(len, s[i : i + x])) + x, sum(map(len, t[j : j + y])) + y)
        i, j = i + x, j + y
    return cost + max(sum(map(len, s[i:])) + n - i, sum(map(len, t[j:])) + m - j)


def similar(a: str, b: str, similarity: float) -> bool:
    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    return abs(len(a) - len(b)) <= most and (edit_bound(a, b) <= most or edit_distance(a, b, most) <= most)


def _lines(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each block: number, ids, folded bytes, words (start, end), (first word, end), line and text of the lines that have words."""
    for block, ids, data, cuts in opened(batch):
        starts, row = split_lines(data, cuts)
        low, start, end, _, first = normalised(data, starts, cuts)
        use = np.flatnonzero(np.diff(first))
        yield block, ids, low, start, end, first[:-1][use], first[1:][use], use, row[use]


def _near(sim: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines i and j may be similar. length: of the normalised line, negative below SMALL features."""
    a, b = np.abs(length[i]), np.abs(length[j])
    fits = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6
    return fits & ((np.bitwise_count(sim[i] ^ sim[j]) <= RADIUS) | (length[i] < 0) | (length[j] < 0))


def first_meetings(key: np.ndarray, sim: np.ndarray, length: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines sorted by key: pairs of places, so that each line that is near another of its key is in one; and who is in any."""
    lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(lead, len(key)))
    start, stop = np.repeat(lead, size), np.repeat(lead + size, size)
    xs, ys, paired = [], [], np.zeros(len(key), bool)
    i, step = np.flatnonzero(np.repeat(size > 1, size)), 0
    while len(i):  # those without a partner yet with the one `step` places after their key's first
        i = i[i - start[i] > step]
        x = start[i] + step
        ok = _near(sim, length, x, i, similarity)
        xs.append(x[ok])
        ys.append(i[ok])
        i = i[~ok]
        step += 1
    for v in (*xs, *ys):
        paired[v] = True
    i, step = np.flatnonzero(~paired & np.repeat(size > 1, size)), 0
    while len(i):  # those in no pair so far, with the first one after them that is near, which has met another
        step += 1
        i = i[i + step < stop[i]]
        ok = _near(sim, length, i, i + step, similarity)
        xs.append(i[ok])
        ys.append(i[ok] + step)
        paired[i[ok]] = True
        i = i[~ok]
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    return x, y, paired


def _meet(texts: DataFrame, groups: int, similarity: float) -> DataFrame:
    """x, y (hashes a of two near lines), and, with key, sim, length, the near lines x of keys that have three or more."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = _U(64 - int(np.log2(groups)))
        for batch in batches:
            for _, _, low, start, end, first, stop, _, _ in _lines(batch):
                if not len(first):
                    continue
                h = hash_words(low, start, end)
                a, once = np.unique(hash_runs(h, first, stop), return_index=True)
                first, stop = first[once], stop[once]
                size = np.concatenate(([0], np.cumsum(((low & 0xC0) != 0x80).astype(np.int64))))
                letters = np.concatenate(([0], np.cumsum(size[end] - size[start])))
                length = letters[stop] - letters[first] + stop - first - 1
                key, line, sim, wide = keys_of(low, start, end, first, stop, h)
                length = np.where(wide, length, -length)
                order = np.argsort(key)
                key, line = key[order], line[order]
                cut = np.searchsorted(key >> shift, np.arange(groups + 1, dtype=_U)).tolist()
                full = [(g, slice(cut[g], cut[g + 1])) for g in range(groups) if cut[g] < cut[g + 1]]
                a, sim, length = a[line].view(np.int64), sim[line], length[line].astype(np.int32)
                yield pa.record_batch(
                    [pa.array([g for g, _ in full], pa.int32()), pa.array([pack(key[p]) for _, p in full], pa.binary()), *(pa.array([v[p].tobytes() for _, p in full], pa.binary()) for v in (a, sim)), pa.array([planes(length[p]) for _, p in full], pa.binary())],
                    names=["g", "key", "a", "sim", "length"],
                )

    def meet(group: pa.Table) -> pa.Table:
        key = np.concatenate([unpack(x.as_py()) for x in group.column("key")])
        order = np.argsort(key, kind="stable")
        key = key[order]
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        key, order = key[shared], order[shared]
        a, sim = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(v)])[order] for v, kind in (("a", "<i8"), ("sim", "<u8")))
        length = np.concatenate([unplanes(x.as_py(), "<i4") for x in group.column("length")])[order]
        order = np.lexsort((a, key))
        key, a, sim, length = key[order], a[order], sim[order], length[order]
        new = np.ones(len(key), bool)  # a line is once in a key, however many blocks of texts have it
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1])
        key, a, sim, length = key[new], a[new], sim[new], length[new]
        x, y, paired = first_meetings(key, sim, length, similarity)
        pair = np.unique(np.stack((np.minimum(a[x], a[y]), np.maximum(a[x], a[y]))), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        at = np.flatnonzero(paired)
        _, of, n = np.unique(key[at], return_inverse=True, return_counts=True)
        at = at[n[of] > 2]
        none = np.ones(len(at), bool)
        return pa.table(
            {
                "x": pa.array(np.concatenate((pair[0], a[at]))),
                "y": pa.array(np.concatenate((pair[1], a[at])), mask=np.concatenate((np.zeros(pair.shape[1], bool), none))),
                "key": pa.array(np.concatenate((np.zeros(pair.shape[1], np.int64), key[at].view(np.int64)))),
                "sim": pa.array(np.concatenate((np.zeros(pair.shape[1], np.int64), sim[at].view(np.int64)))),
                "length": pa.array(np.concatenate((np.zeros(pair.shape[1], np.int32), length[at]))),
            }
        )

    packed = texts.select("block", "ids", "cuts", "texts").mapInArrow(spread, "g int, key binary, a binary, sim binary, length binary")
    return materialise(packed.groupBy("g").applyInArrow(meet, "x long, y long, key long, sim long, length int"), "met")


def _apart(members: DataFrame, similarity: float) -> DataFrame:
    """From (key, gid, sim, length, component): pairs x, y of one key that are near and of different components."""

    def cross(group: pa.Table) -> pa.Table:
        gid, sim, length, own = (group.column(c).to_numpy() for c in ("gid", "sim", "length", "component"))
        order = np.lexsort((gid, own))
        gid, sim, length, own = gid[order], sim[order].view(_U), length[order], own[order]
        j = np.searchsorted(own, own, side="right")  # the first place of the next component
        i, xs, ys = np.arange(len(gid)), [], []
        while True:
            live = j < len(gid)
            i, j = i[live], j[live]
            if not len(i):
                break
            ok = _near(sim, length, i, j, similarity)
            xs.append(gid[i[ok]])
            ys.append(gid[j[ok]])
            j = j + 1
        return pa.table({"x": pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64)), "y": pa.array(np.concatenate(ys) if ys else np.zeros(0, np.int64))})

    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    some = members.join(mixed, "key", "left_semi")
    return some.groupBy("key").applyInArrow(cross, "x long, y long").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _texts(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """gid, a, line (normalised) of all in the pairs."""
    ends = pairs.select(F.col("x").alias("a")).unionByName(pairs.select(F.col("y").alias("a"))).distinct()
    wanted = materialise(nodes.join(ends, "a").select("gid", "a", "place.block", "place.at"), "wanted")
    n = wanted.count()
    bits = int(np.log2(power_of_two(16 * n, 16, BITMAP_BITS)))
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("block", F.col("at").cast("long")).alias("a")), bits))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, shift = shared.value, np.uint64(64 - bits)
        for batch in batches:
            for block, _, data, cuts in opened(batch):
                starts, _ = split_lines(data, cuts)
                size = np.diff(starts)
                if len(data):
                    size -= (size > 0) & (data[starts[1:] - 1] == 10)
                place = _xxhash64(np.arange(len(size)), int(_xxhash64(np.array([block]), 42)[0]))
                hit = np.flatnonzero((size > 0) & set_in(seen, place >> shift))
                size = size[hit]
                cut = np.concatenate(([0], np.cumsum(size)))
                low, start, end, row, _ = normalised(data[np.repeat(starts[hit] - cut[:-1], size) + np.arange(cut[-1])], cut, cut)
                line = joined_words(low, start, end, row, len(hit))
                yield pa.record_batch([pa.array(np.full(len(hit), block)), pa.array(hit.astype(np.int32)), line], names=["block", "at", "line"])

    got = texts.select("block", "ids", "cuts", "texts").mapInArrow(fetch, "block long, at int, line string")
    return materialise(got.join(wanted, ["block", "at"]).select("gid", "a", "line"), "candidates")


def _xxhash64(values: np.ndarray, seed: int) -> np.ndarray:
    """Spark's xxhash64() of longs, after columns whose hash is `seed`."""
    turn = lambda x, n: x << _U(n) | x >> _U(64 - n)
    one, two, three, four = (_U(p) for p in _PRIMES[:4])
    h = _U((seed + _PRIMES[4] + 8) % (1 << 64)) ^ turn(values.astype(np.int64).view(_U) * two, 31) * one
    h = turn(h, 27) * one + four
    h = (h ^ h >> _U(33)) * two
    h = (h ^ h >> _U(29)) * three
    return h ^ h >> _U(32)


def _verify(pairs: DataFrame, known: DataFrame, on: str, similarity: float) -> DataFrame:
    """The pairs (x, y), values of known's column `on`, as gids (a, b), and whether their edit similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(s, t, similarity) for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("p"), batch.column("q"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    one = known.select(F.col(on).alias("x"), F.col("gid").alias("p"), F.col("line").alias("s"))
    two = known.select(F.col(on).alias("y"), F.col("gid").alias("q"), F.col("line").alias("t"))
    return pairs.join(one, "x").join(two, "y").select("p", "q", "s", "t").mapInArrow(run, "a long, b long, ok boolean")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs (doc_id, text, any other columns) without repeated lines."""
    names = docs.columns
    texts = blocks(docs, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, low, start, end, first, stop, line, row in _lines(batch):
                h = hash_words(low, start, end)
                a, b = hash_runs(h, first, stop), hash_runs(h, first, stop, 1)
                own = ids.fill_null(_LAST).to_numpy()[row]
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(own), pa.array(np.full(len(a), block)), pa.array(line.astype(np.int32))], names=["a", "b", "own", "block", "at"])

    lines = materialise(texts.select("block", "ids", "cuts", "texts").mapInArrow(scan, "a long, b long, own long, block long, at int"), "lines")
    place = F.struct("own", "block", "at")
    nodes = lines.groupBy("a", "b").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes.withColumn("gid", F.monotonically_increasing_id()), "nodes")
    met = _meet(texts, power_of_two(nodes.count() * 8 / (1 << GROUP_BITS), 3, 16), similarity)
    pairs = materialise(met.filter("y IS NOT NULL").select("x", "y").distinct(), "pairs")
    known = _texts(texts, nodes, pairs)
    tried = materialise(_verify(pairs, known, "a", similarity), "tried")
    of = components(tried.filter("ok").select("a", "b"))
    some = known.select("gid", "a").join(of.withColumnRenamed("node", "gid"), "gid", "left").select("gid", "a", F.coalesce("component", "gid").alias("component"))
    some = materialise(some, "some")
    members = materialise(met.filter("y IS NULL").select(F.col("x").alias("a"), "key", "sim", "length").join(some, "a"), "members")
    failed = tried.filter("NOT ok").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    rest = _apart(members, similarity).join(failed, ["x", "y"], "left_anti")
    more = materialise(_verify(rest, known, "gid", similarity).filter("ok").select("a", "b"), "more")
    if not more.isEmpty():  # components that turn out to be one
        where = some.select("gid", "component")
        ends = more.join(where.withColumnRenamed("component", "p").withColumnRenamed("gid", "a"), "a").join(where.withColumnRenamed("component", "q").withColumnRenamed("gid", "b"), "b")
        joined = components(ends.select("p", "q"), "p", "q").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        of = some.join(joined, "component", "left").select(F.col("gid").alias("node"), F.coalesce("whole", "component").alias("component"))
    grouped = nodes.join(of, nodes["gid"] == of["node"], "left").filter("n > 1 OR component IS NOT NULL").select("a", "b", "place", "n", F.coalesce("component", "gid").alias("component"))
    grouped = materialise(grouped, "grouped")
    kept = grouped.groupBy("component").agg(F.min("place").alias("kept"), F.count(F.lit(1)).alias("lines"))
    keys = materialise(join_hot(grouped, materialise(kept, "kept"), ["component"], "lines").select("a", "b", "n", "kept"), "keys")
    gone = join_hot(lines, keys, ["a", "b"], "n").filter(place != F.col("kept")).groupBy("block").agg(F.collect_list("at").alias("gone"))
    count = "n_chars" in names

    def rebuild(block: pa.Table, found: pa.Table) -> pa.Table:
        outs = []
        for (_, ids, data, cuts), rest in zip(opened(block), block.column("rest") if "rest" in block.column_names else [None] * block.num_rows, strict=True):
            starts, row = split_lines(data, cuts)
            keep = np.ones(len(row), bool)
            for g in found.column("gone"):
                keep[g.values.to_numpy()] = False
            held = starts[:-1][keep], starts[1:][keep]
            size = held[1] - held[0]
            at = np.concatenate(([0], np.cumsum(size)))
            stream = data[np.repeat(held[0] - at[:-1], size) + np.arange(at[-1])]
            left = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(ids)))))
            cut = at[left]
            broken = (cut[1:] > cut[:-1]) & (left[1:] > left[:-1])
            tail = np.zeros(len(ids), bool)  # a last line that went leaves a line break behind
            ends = np.append(np.flatnonzero(row[1:] != row[:-1]), len(row) - 1)
            tail[row[ends]] = ~keep[ends]
            tail &= broken
            if tail.any():
                stream = np.delete(stream, cut[1:][tail] - 1)
                cut = cut - np.concatenate(([0], np.cumsum(tail)))
            text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(np.ascontiguousarray(cut, np.int64)), pa.py_buffer(stream.tobytes())).cast(pa.string())
            cols = {"doc_id": ids, "text": text}
            if rest is not None:
                cols |= dict(zip([f.name for f in rest.values.type], rest.values.flatten(), strict=True))
            if count:
                cols["n_chars"] = pa.compute.utf8_length(text).cast(cols["n_chars"].type)
            outs.append(pa.table({c: cols[c] for c in names}))
        return pa.concat_tables(outs)

    schema = docs.schema
    return texts.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(rebuild, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
