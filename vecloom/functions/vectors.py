"""Vectors: as columns where Spark's functions do, as numpy arrays inside Arrow functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def normalise(v: Column) -> Column:
    """Unit length; a vector of next to no length stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n < _TINY, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / n))


def truncated(v: Column, dim: int) -> Column:
    """The first `dim` values, then normalised."""
    return normalise(F.slice(v, 1, dim) if dim else v)


def base64(b: Column) -> Column:
    """Standard alphabet, padded, on one line."""
    return F.regexp_replace(F.base64(b), "[\r\n]", "")


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n < _TINY, v, v / np.where(n < _TINY, 1, n))


def pooled(hidden: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """From (rows, seq, dim): the first token's vector, or the mean over the mask (zero where it is empty)."""
    if pooling == "cls":
        return hidden[:, 0]
    m = (mask != 0)[..., None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1)


def packed(v: np.ndarray) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    """A last part of fewer than four bytes is left out."""
    return np.frombuffer(blob[: len(blob) // 4 * 4], "<f4")
