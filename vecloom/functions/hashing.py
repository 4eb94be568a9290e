"""Content hashes. Every user takes the hash as a parameter: 128-bit FNV-1a by default, md5 where SQL has to give it too."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HashFn = Callable[[Column], Column]

# Offset and prime of 128-bit FNV-1a.
_OFFSET = 0x6C62272E07BB014262B821756295C58D
_PRIME = (1 << 88) + 0x13B
_MASK = (1 << 128) - 1


def fnv1a_128(data: bytes) -> str:
    h = _OFFSET
    for b in data:
        h = (h ^ b) * _PRIME & _MASK
    return f"{h:032x}"


#: The prime's lower half, cut in 32 bits; its upper half is 2**24.
_P0 = np.uint64(_PRIME & 0xFFFFFFFF)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def fnv1a_128_all(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower 64 bits of the hash of each span: one byte of all spans at a time, the longest spans first.

    The prime is 2**88 + p with p < 2**32, so state * prime is state * p with state's lower half shifted by 88 added.
    """
    order = np.argsort(start - end, kind="stable")
    at, left = start[order].copy(), (end - start)[order]
    high = np.full(len(at), _OFFSET >> 64, np.uint64)
    low = np.full(len(at), _OFFSET & (1 << 64) - 1, np.uint64)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for step, n in enumerate(live.tolist()):
        h, x = high[:n], low[:n] ^ data[at[:n] + step]
        a, b = (x & _LOW) * _P0, (x >> _HALF) * _P0
        carry = (a >> _HALF) + b
        high[:n] = h * _P0 + (carry >> _HALF) + (x << np.uint64(24))
        low[:n] = (carry << _HALF) | (a & _LOW)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return high[back], low[back]


#: Texts that are hashed together.
_TOGETHER = 4096


@F.pandas_udf(StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    known = texts[texts.notna()]
    for i in range(0, len(known), _TOGETHER):
        part = known.iloc[i : i + _TOGETHER]
        coded = [t.encode() for t in part]
        cut = np.concatenate(([0], np.cumsum([len(t) for t in coded])))
        high, low = fnv1a_128_all(np.frombuffer(b"".join(coded), np.uint8), cut[:-1], cut[1:])
        out[part.index] = [f"{h:016x}{x:016x}" for h, x in zip(high.tolist(), low.tolist(), strict=True)]
    return out


def text_hash(text: Column) -> Column:
    return _fnv(text)


def md5(text: Column) -> Column:
    return F.md5(text)
