"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (a run of letters, lower-cased) is the mean of the vectors of its byte n-grams (3, 5 and 7 bytes, with marks for
its ends) and of itself, all hashed into 2**BUCKET_BITS rows. A text is the mean of its words; a linear softmax tells
the classes apart. Vectors and softmax are trained together with Adagrad. As a misspelt word shares most n-grams with
its origin, it shares most of its vector too. For scoring, vectors and softmax fold into one number a bucket
(2**BUCKET_BITS floats, the whole of what is sent to the executors).

The model is fitted on a bounded sample of labelled rows: those of at most MAX_TRAIN_TEXT bytes, in order of a hash of
the id, up to MAX_TRAIN_ROWS rows with MAX_TRAIN_BYTES bytes in all. Scoring covers all rows and whole texts.

Defined results: null and empty texts, and texts without letters, get the score of the bias alone; rows whose label is
null are not learnt from; with no labelled rows or one class only, all scores are that class's share (0 where there is
none); repeated rows score alike; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hash_spans, mix, slices, spans, text_bytes, trim

BUCKET_BITS = 18
DIM = 8
GRAMS = (3, 5, 7)
SCALE = 80.0
#: Neutral words that each text's mean takes in, so that a few words alone decide little.
PRIOR_WORDS = 16
#: Weight of a text of class 1 in training.
WEIGHT = 1.0
MAX_TRAIN_ROWS = 8000
MAX_TRAIN_BYTES = 12 << 20
#: Longer texts are scored like any other, but not learnt from.
MAX_TRAIN_TEXT = 6000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.compute.utf8_lower(column.cast(pa.large_string())))


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams, and the words' offsets in them."""
    n = end - start
    size = n + 2
    at = np.concatenate(([0], np.cumsum(size)))
    own = np.repeat(np.arange(len(n)), size)
    pos = np.arange(at[-1]) - at[own]
    stream = np.full(at[-1], ord("<"), np.uint64)
    stream[at[1:] - 1] = ord(">")
    inner = (pos > 0) & (pos <= n[own])
    stream[inner] = data[(start[own] + pos - 1)[inner]]
    left = size[own] - pos
    whole = mix(hash_spans(data, start, end) + np.uint64(1))
    keys, words = [whole], [np.arange(len(n))]
    gram = np.zeros(at[-1], np.uint64)
    for k in range(max(GRAMS)):
        if k >= at[-1]:
            break
        gram[: at[-1] - k] |= stream[k:] << np.uint64(8 * k)
        if k + 1 in GRAMS:
            ok = left > k
            keys.append(mix(gram[ok] & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64(k + 1 << 56)))
            words.append(own[ok])
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    bucket = (np.concatenate(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(n)))))


def _by_slice(texts: list[str | None]) -> Iterator[tuple]:
    """By slices of the texts: the words' names (hashes), their buckets and offsets, (text, word, count) of each pair."""
    done = 0
    for part in slices(pa.record_batch([pa.array(texts, pa.string())], names=["text"]), most=1 << 19):
        data, off = lowered(part.column("text"))
        start, end, row = spans(_LETTER[data], off)
        name, first, kind = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        pair, count = np.unique(row * max(1, len(name)) + kind, return_counts=True)
        yield name, *word_grams(data, start[first], end[first]), pair // max(1, len(name)) + done, pair % max(1, len(name)), count
        done += part.num_rows


def train(texts: list[str | None], toxic: np.ndarray, epochs: int = 8, rate: float = 0.4, batch: int = 64, least: int = 5, damp: float = 0.005, seed: int = 5) -> tuple[np.ndarray, float]:
    """(number for each bucket, bias) of the log-odds of class 1. Buckets met in fewer than `least` texts stay zero."""
    zero = np.zeros(1 << BUCKET_BITS, np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return zero, 30.0 if len(toxic) and toxic.max() else -30.0
    met = np.zeros(1 << BUCKET_BITS)
    for _, bucket, cut, _, word, _ in _by_slice(texts):
        met += np.bincount(bucket, np.repeat(np.bincount(word, minlength=len(cut) - 1), np.diff(cut)), len(met))
    often = met >= least
    slot, n_slots = (np.cumsum(often) - 1).astype(np.int32), int(often.sum())
    names, parts, sizes, fulls, docs, kinds, counts, seen = [], [], [], [], [], [], [], 0
    for name, bucket, cut, doc, word, count in _by_slice(texts):
        keep = often[bucket]
        names.append(name)
        parts.append(slot[bucket[keep]])
        sizes.append(np.diff(np.concatenate(([0], np.cumsum(keep)))[cut]))
        fulls.append(np.diff(cut).astype(np.float32))
        docs.append(doc.astype(np.int32))
        kinds.append((word + seen).astype(np.int32))
        counts.append(count.astype(np.float32))
        seen += len(name)
    _, first, of = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    size, full = np.concatenate(sizes), np.concatenate(fulls)[first]
    cut = np.concatenate(([0], np.cumsum(size)))
    gram_off = np.concatenate(([0], np.cumsum(size[first])))
    take = np.repeat((cut[first] - gram_off[:-1]).astype(np.int32), size[first])
    take += np.arange(gram_off[-1], dtype=np.int32)
    grams = np.concatenate(parts)[take]
    del parts, names, take
    pair_doc, pair_word, pair_n = np.concatenate(docs), of[np.concatenate(kinds)].astype(np.int32), np.concatenate(counts)
    pair_off = np.searchsorted(pair_doc, np.arange(len(texts) + 1))
    words = np.bincount(pair_doc, pair_n, len(texts))
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1, 1, (n_slots, DIM)).astype(np.float32) / DIM
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    vec_sq, soft_sq, bias_sq = np.full((n_slots, 1), damp**2, np.float32), np.full_like(soft, damp**2), np.full_like(bias, damp**2)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            rows = rows[words[rows] > 0]
            if not len(rows):
                continue
            pair = np.concatenate([np.arange(a, b) for a, b in zip(pair_off[rows], pair_off[rows + 1], strict=True)])
            doc = np.repeat(np.arange(len(rows)), np.diff(pair_off)[rows])
            used, local = np.unique(pair_word[pair], return_inverse=True)
            size = gram_off[used + 1] - gram_off[used]
            cut = np.concatenate(([0], np.cumsum(size)))
            gram = grams[np.repeat(gram_off[used] - cut[:-1], size) + np.arange(cut[-1])]
            sums = np.concatenate((np.zeros((1, DIM)), np.cumsum(vec[gram], axis=0, dtype=np.float64)))
            word = ((sums[cut[1:]] - sums[cut[:-1]]) / full[used, None]).astype(np.float32)
            share = np.zeros((len(rows), len(used)), np.float32)
            share[doc, local] = pair_n[pair]
            share *= SCALE / (words[rows][:, None] + PRIOR_WORDS)
            mean = share @ word
            z = mean @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), toxic[rows]] -= 1
            p *= np.where(toxic[rows] == 1, WEIGHT, 1)[:, None] / len(rows)
            g_word = share.T @ (p @ soft.T) / full[used, None]
            g_soft, g_bias = mean.T @ p, p.sum(0)
            soft_sq += g_soft**2
            soft -= step * g_soft / np.sqrt(soft_sq)
            bias_sq += g_bias**2
            bias -= step * g_bias / np.sqrt(bias_sq)
            owner = np.repeat(np.arange(len(used)), size)
            g_vec = np.stack([np.bincount(gram, g_word[owner, d], n_slots) for d in range(DIM)], 1).astype(np.float32)
            vec_sq += (g_vec**2).mean(1, keepdims=True)
            vec -= step * g_vec / np.sqrt(vec_sq)
    zero[often] = SCALE * (vec @ (soft[:, 1] - soft[:, 0]))
    trim()
    return zero, float(bias[1] - bias[0])


def score_texts(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    data, off = lowered(column)
    start, end, row = spans(_LETTER[data], off)
    n = len(column)
    if not len(start):
        return np.full(n, 1 / (1 + np.exp(-bias)))
    _, first, kind = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
    grams, cut = word_grams(data, start[first], end[first])
    word = np.add.reduceat(weights[grams].astype(np.float64), cut[:-1]) / np.diff(cut)
    word = np.round(word, 6)  # sums of multiples of one power of two would be exact; this keeps equal texts equal in any batch
    count = np.bincount(row, minlength=n)
    logit = np.bincount(row, word[kind], n) / (count + PRIOR_WORDS) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAIN_ROWS, most: int = MAX_TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels to fit on; labels: (doc_id, toxic)."""
    spark = docs.sparkSession
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = docs.select("doc_id", F.octet_length("text").alias("n")).join(marks, "doc_id").filter(F.col("n").between(1, MAX_TRAIN_TEXT))
    chosen = sized.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "n").limit(rows).collect()
    ids, total = {}, 0
    for r in chosen:
        total += r.n
        if total > most and ids:
            break
        ids[r.doc_id] = int(r.toxic)
    if not ids:
        return [], np.zeros(0, np.int64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], f"doc_id {kind}"))  # at most `rows` ids
    got = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").filter("length(text) > 0").join(wanted, "doc_id").collect())
    return [t for _, t in got], np.array([ids[i] for i, _ in got], np.int64)


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns and `score` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    width = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = score_texts(part.column("text"), shared.value, bias)
                yield pa.record_batch([*part.columns[:width], pa.array(s)], names=[*id_cols, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return docs.select(*id_cols, "text").mapInArrow(run, f"{kinds}, score double")


def keep(docs: DataFrame, weights: np.ndarray, bias: float, below: float) -> DataFrame:
    """The rows of docs that score less than `below`."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, most=1 << 18):
                yield part.filter(pa.array(score_texts(part.column("text"), shared.value, bias) < below))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return train(*sample(docs, labels))
