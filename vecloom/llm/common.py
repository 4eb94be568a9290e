"""What the operators share: reading tables, shared intermediate tables, Arrow batches as numpy arrays."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to a Python worker; with MAX_DOC_BYTES-sized texts a batch stays below 130 MB.
BATCH_ROWS = 1000
#: Bytes of text that a kernel works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_folders: list[tuple[SparkSession, str] | None] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and, where Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own folder where it is unset (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="vecloom-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage ends here, a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecloom/{uuid.uuid4().hex}-{name}"
    df.write.mode("overwrite").parquet(path)
    _folders.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many intermediate tables there are, for release()."""
    return len(_folders)


def release(first: int, last: int, used_by: DataFrame | None = None) -> None:
    """Deletes the intermediate tables of these numbers, but for those that `used_by` reads."""
    read = used_by.inputFiles() if used_by is not None else []
    for i in range(first, min(last, len(_folders))):
        if _folders[i] and not any(f"/{_folders[i][1].rsplit('/', 1)[1]}/" in f for f in read):
            _delete(*_folders[i])
            _folders[i] = None


def _delete(spark: SparkSession, path: str) -> None:
    jvm, live = SparkContext._jvm, spark.sparkContext._jsc
    conf = live.hadoopConfiguration() if live else jvm.org.apache.hadoop.conf.Configuration()  # the session may have ended
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in filter(None, _folders):
        try:
            _delete(spark, path)
        except Exception:  # one that can't be deleted doesn't keep the others
            continue


def join_hot(rows: DataFrame, one: DataFrame, on: list[str], n: str, most: int = 1 << 15) -> DataFrame:
    """rows joined with `one`, which has each key once and in column `n` how many rows have it.

    The keys of more than the `most`-th part of the rows, at most `most` of them, are broadcast; so no task gets more
    rows of one key than that part (or 1,000).
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(1000, total // most)
    few = F.broadcast(one.filter(hot))
    if one.filter(hot).isEmpty():
        return rows.join(one, on)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(one.filter(~hot), on))


def total_bytes(docs: DataFrame, col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def power_of_two(x: float, least: int, most: int) -> int:
    return 1 << int(min(most, max(least, np.ceil(np.log2(max(x, 1))))))


def forget() -> None:
    """Drops what earlier stages keep in a worker that is used again: powers for hashes, the tokenizer and its cache."""
    _powers.clear()
    bpe = sys.modules.get(f"{__package__}.bpe")
    if bpe:
        bpe._codecs.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the system, which a worker that lives on would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, col: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its text reaches `most` bytes."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(col)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    trim()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets (n + 1) in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True in `inside`; runs end at the rows' offsets."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cut = off[(off > 0) & (off < n)]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """runs(), and the row of each."""
    start, end = runs(inside, off)
    return start, end, np.searchsorted(off, start, side="right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each row."""
    return spans(~_SPACE[data], off)


_U = np.uint64
_ODD = {0: (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), 1: (0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5)}
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _power(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get((seed, 0))
    if have is None or len(have[0]) < n:
        m = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        base = _ODD[seed][1]
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(m, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[seed, 0] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


_salts = [np.random.Generator(np.random.PCG64(7 + s)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for s in (0, 1)]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial over salted byte values, then mixed with the length."""
    n = len(data) + 1
    up, down = _power(seed, n)
    sums = np.empty(n, _U)
    sums[0] = 0
    np.cumsum(_salts[seed][data] * up[: n - 1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(_ODD[seed][0]))


def hash_without(data: np.ndarray, start: np.ndarray, end: np.ndarray, hole: np.ndarray, after: np.ndarray, seed: int = 0) -> np.ndarray:
    """hash_spans() of each span without its bytes from hole to after."""
    n = len(data) + 1
    up, down = _power(seed, n)
    sums = np.empty(n, _U)
    sums[0] = 0
    np.cumsum(_salts[seed][data] * up[: n - 1], out=sums[1:])
    gone = after - hole
    value = (sums[hole] - sums[start] + (sums[end] - sums[after]) * down[gone]) * down[start]
    return mix(value + (end - start - gone).astype(_U) * _U(_ODD[seed][0]))


def hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run values[start:end] of 64-bit values, of any length."""
    up, down = _power(seed, len(values) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(values ^ _U(_ODD[seed][0])) * up[:-1])))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(_ODD[seed][0]))


def roll(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive hashes; len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    base = _U(_ODD[seed][1])
    for j in range(k):
        out = out * base + h[j : j + n]
    return mix(out)


_LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


def bit_counts(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each of the consecutive runs of `size` values (none of them empty): (run, bit).

    Eight counters of eight bits share a word, so runs are summed in pieces of at most 255 values.
    """
    pieces = -(-size // 255)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    of = np.concatenate(([0], np.cumsum(pieces)))[:-1]
    at = np.repeat(first - of * 255, pieces) + np.arange(pieces.sum()) * 255
    lanes = _LANES[np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(lanes, at, axis=0).astype("<u8").view(np.uint8).reshape(len(at), 64)
    return np.add.reduceat(counts, of, axis=0, dtype=np.int32) if len(at) > len(size) else counts


def majority(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run the 64-bit value whose bits are 1 where they are in over half the run's values."""
    return most_bits(bit_counts(h, size), size)


def most_bits(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 64-bit values of the bits that are in over half of each run, from bit_counts()."""
    over = counts > (size // 2).astype(counts.dtype)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def within(row: np.ndarray, k: int) -> np.ndarray:
    """For each k consecutive words: whether they are of one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, bool)
