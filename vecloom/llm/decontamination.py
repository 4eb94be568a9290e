"""Benchmark decontamination by template canonicalisation.

A text becomes a template: numbers (several words for one number, or a fraction, as one), units and names (capitalised
words, several in a row as one, at a sentence's start too, as what stands before a quotation should not matter) turn
into typed placeholders, other words into their lower-cased letters. Windows of `width` template tokens are joined with
those of the benchmark's items by hash; in front of the join, a bitmap of bounded size keeps back nearly all windows
that no item has. An item counts only where `share` of its windows match, so one of its `1 - share` rarest windows and
one more has to; only these look for candidates, and a window that many items share joins no more than it must. What
matches on near diagonals (place in the text less place in the item, DRIFT apart at most from one to the next) is one
alignment, as a word more or less moves the rest. It counts if it holds at least `share` of the item's windows and its
slots are consistent: each value in the item's slots stands for one value in the text. So a question with other numbers
or names is caught, and an unrelated text of like form not.

Defined results: null and empty texts have no windows; an item with fewer than `width` tokens, but at least MIN_ITEM, is
one window, matched by texts' windows of its own length; a window needs `literals` literal tokens (all but one where it
is shorter). An item without such a window is matched by its windows with any literal, names taken as literals, if a
third of its tokens are such and two at least, else by the exact words and numbers of all its windows. An item of fewer than MIN_ITEM tokens
matches texts of just these tokens; one without tokens matches nothing; of rows with equal id and text all or none match; empty tables give no
rows or no matches; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hash_runs, hash_spans, materialise, power_of_two, slices, spans, text_bytes
from .packing import bitmap, set_in, without

WIDTH = 5
SHARE = 0.8
LITERALS = 3
MIN_ITEM = 3
DRIFT = 2
BITMAP_BITS = 26

#: Units of measure, and words for numbers, that count as such.
UNITS = (
    "mm cm dm m km inch inches foot feet ft yard yards mile miles g mg kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros eur usd percent degree degrees kmh mph hz khz mhz ghz w kw kwh v volt volts watt watts kb mb gb tb"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

NUMBER, UNIT, NAME = (np.uint64(k) for k in (1, 2, 3))

#: What windows an item is matched by: with enough literals; with any literal, names counted as such; by exact values; whole texts by exact values.
USUAL, SPARSE, EXACT, WHOLE = range(4)


def _hashes(listed: list[str]) -> np.ndarray:
    data, off = text_bytes(pa.array(listed))
    return np.sort(hash_spans(data, off[:-1], off[1:]))


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS)


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each template token: its code (placeholders 1 to 3, else the word's hash), the hash of its text, its row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    digit, alpha = _DIGIT[data], _ALPHA[data]
    inner = np.zeros(len(data), bool)
    inner[1:-1] = digit[:-2] & digit[2:] & ((data[1:-1] == ord(".")) | (data[1:-1] == ord(",")))
    inner[off[(off > 0) & (off < len(data))] - 1] = False
    number = digit | inner
    n_start, n_end, n_row = spans(number, off)
    a_start, a_end, a_row = spans(alpha, off)
    start, end, row = np.concatenate((n_start, a_start)), np.concatenate((n_end, a_end)), np.concatenate((n_row, a_row))
    is_number = np.arange(len(start)) < len(n_start)
    by = np.argsort(start, kind="stable")
    start, end, row, is_number = start[by], end[by], row[by], is_number[by]
    word = hash_spans(_LOWER[data], start, end)
    code = word.copy()
    code[is_number | np.isin(word, _NUMBER_HASHES)] = NUMBER
    code[np.isin(word, _UNIT_HASHES) & (code != NUMBER)] = UNIT
    second = data[np.minimum(start + 1, len(data) - 1)]
    capital = _UPPER[data[start]] | ((data[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    code[capital & (code != NUMBER) & (code != UNIT)] = NAME
    # names in a row are one slot, and so are numbers of several words and fractions
    name, amount = code == NAME, code == NUMBER
    more = np.zeros(len(code), bool)
    gap = start[1:] - end[:-1]
    between = data[np.minimum(end[:-1], len(data) - 1)]
    more[1:] = name[1:] & name[:-1] & (gap == 1) & ((between == ord(" ")) | (between == ord("-")))
    spelt = ~is_number[1:] | ~is_number[:-1]
    more[1:] |= amount[1:] & amount[:-1] & (gap == 1) & ((between == ord("/")) | spelt & ((between == ord(" ")) | (between == ord("-"))))
    more[1:] &= row[1:] == row[:-1]
    lead = np.flatnonzero(~more)
    value = hash_runs(word, lead, np.append(lead[1:], len(code)), 1) if len(lead) else word
    return code[lead], value, row[lead]


def _windows(code: np.ndarray, value: np.ndarray, row: np.ndarray, width: int, literals: int, way: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows of `width` tokens that count this way."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = {USUAL: literals, SPARSE: 1}.get(way, 0)
    literal = np.concatenate(([0], np.cumsum(code > (UNIT if way == SPARSE else NAME))))
    ok = (row[:n] == row[width - 1 :]) & (literal[width:] - literal[:n] >= least)
    if way == WHOLE:
        ok[1:] &= row[1:n] != row[: n - 1]
        ok[:-1] &= row[: n - 1] != row[width:]
    at = np.flatnonzero(ok)
    what = value if way >= EXACT else np.where(code == NAME, value, code) if way == SPARSE else code
    return at, hash_runs(what, at, at + width)


def _ways(code: np.ndarray, row: np.ndarray, size: np.ndarray, width: int, literals: int) -> np.ndarray:
    """The way of each item, which has `size` tokens."""
    n = np.bincount(row, (code > UNIT).astype(np.int64), len(size))
    way = np.where((n >= 2) & (3 * n >= size), SPARSE, EXACT)
    for k in range(MIN_ITEM, width + 1):
        mine = size >= width if k == width else size == k
        sub = np.flatnonzero(mine[row])
        at, _ = _windows(code[sub], code[sub], row[sub], k, literals if k == width else min(literals, k - 1), USUAL)
        way[row[sub][at]] = USUAL
    way[size < MIN_ITEM] = WHOLE
    return way


def _slots(code: np.ndarray, value: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """The values of each window's slots."""
    where = at[:, None] + np.arange(width)
    slot = code[where] <= NAME
    count = np.concatenate(([0], np.cumsum(slot.sum(1))))
    return pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(value[where[slot]].view(np.int64)))


_FOUND = "w long, way int, width int, place long, slots array<long>"


def _item_windows(items: DataFrame, width: int, literals: int) -> DataFrame:
    """item, w (window hash), way, width, place, slots, total (windows of the item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                code, value, row = template(*text_bytes(part.column("text")))
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                size = np.diff(first)
                way = _ways(code, row, size, width, literals)
                for k, m in [(k, m) for k in range(1, width + 1) for m in (USUAL, SPARSE, EXACT, WHOLE)]:
                    mine = (size >= width if k == width else size == k) & (way == m)
                    use = mine[row]
                    sub = np.flatnonzero(use)
                    if not len(sub):
                        continue
                    at, w = _windows(code[sub], value[sub], row[sub], k, literals if k == width else min(literals, k - 1), m)
                    if not len(at):
                        continue
                    own = row[sub][at]
                    total = np.bincount(own, minlength=part.num_rows)
                    yield pa.record_batch(
                        [
                            part.column("item_id").take(pa.array(own)),
                            pa.array(w.view(np.int64)),
                            pa.array(np.full(len(at), m, np.int32)),
                            pa.array(np.full(len(at), k, np.int32)),
                            pa.array(sub[at] - first[own]),
                            _slots(code[sub], value[sub], at, k),
                            pa.array(total[own], pa.int64()),
                        ],
                        names=["item_id", "w", "way", "width", "place", "slots", "total"],
                    )

    kind = items.schema["item_id"].dataType.simpleString()
    return materialise(items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, {_FOUND}, total long"), "items")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, literals: int = LITERALS) -> DataFrame:
    """row (xxhash64 of id and text), item_id, found (share of the item's windows), changed (whether a slot has another value)."""
    known = _item_windows(items, width, literals)
    n = known.count()
    bits = int(np.log2(power_of_two(64 * n, 16, BITMAP_BITS)))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(known.select(F.col("w").alias("a")), bits))
    kinds = [(r.way, r.width) for r in known.select("way", "width").distinct().collect()]  # at most 4 x width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - bits)
        forget()
        for batch in batches:
            for part in slices(batch, most=1 << 18):
                code, value, row = template(*text_bytes(part.column("text")))
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                for m, k in kinds:
                    at, w = _windows(code, value, row, k, literals if k == width else min(literals, k - 1), m)
                    hit = set_in(shared.value, w >> shift)
                    at, w = at[hit], w[hit]
                    if len(at):
                        yield pa.record_batch(
                            [part.column("row").take(pa.array(row[at])), pa.array(w.view(np.int64)), pa.array(np.full(len(at), m, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(at - first[row[at]]), _slots(code, value, at, k)],
                            names=["row", "w", "way", "width", "place", "slots"],
                        )

    hits = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, f"row long, {_FOUND}")
    hits = materialise(hits, "hits")
    key = ["w", "way", "width"]
    common = known.groupBy(*key).agg(F.count(F.lit(1)).alias("items"))
    rarest = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "w", "place"))  # an item's windows
    must = F.col("total") - F.ceil(F.col("total") * share - 1e-9) + 1
    few = known.join(common, key).withColumn("rank", rarest).filter(F.col("rank") <= must).select("item_id", *key).distinct()
    chosen = hits.select("row", *key).distinct().join(few, key).select("row", "item_id").distinct()
    k = known.select("item_id", *key, "total", F.col("place").alias("at"), F.col("slots").alias("mine"))
    met = hits.join(chosen, "row").join(k, ["item_id", *key]).withColumn("pairs", F.arrays_zip("mine", "slots"))
    lines = met.groupBy("row", "item_id", (F.col("place") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("at"), F.first("total").alias("total"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    order = Window.partitionBy("row", "item_id").orderBy("shift")
    begins = F.coalesce((F.col("shift") - F.lag("shift").over(order) > DRIFT).cast("int"), F.lit(1))
    chained = lines.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order))
    whole = chained.groupBy("row", "item_id", "chain").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.first("total").alias("total"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    # a chain with a stray match in it may hold a sound line all the same
    alone = lines.select("row", "item_id", F.lit(0).alias("chain"), F.size("at").alias("n"), "total", "pairs")
    aligned = whole.unionByName(alone)
    sound = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["mine"])))
    changed = F.exists("pairs", lambda p: p["mine"] != p["slots"])
    good = aligned.filter((F.col("n") >= share * F.col("total") - 1e-9) & sound)
    return good.groupBy("row", "item_id").agg(F.max(F.col("n") / F.col("total")).alias("found"), F.min(changed).alias("changed"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, literals: int = LITERALS) -> DataFrame:
    """row, n_items, item_id (the least of those found whole as far as any is), found, changed of each text with a match."""
    m = matches(docs, items, width, share, literals)
    best = F.min(F.struct((-F.col("found")).alias("less"), "item_id", "changed"))
    return materialise(m.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), best.alias("b")).select("row", "n_items", "b.item_id", (-F.col("b.less")).alias("found"), "b.changed"), "contaminated")


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_items, item_id, found, changed of every row; nulls and 0 where nothing matches."""
    hit = contaminated(docs, items)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    return rows.join(hit, "row", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "found", "changed")


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a match."""
    return without(docs, F.xxhash64("doc_id", "text"), contaminated(docs, items).select("row"))
