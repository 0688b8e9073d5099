"""A Bloom filter of fixed size over well-mixed 64-bit keys.

Its size is a parameter, not a function of the data, so it may pass the
driver and be broadcast at any scale. A filter that fills up lets more
through; callers use it only to keep rows back that a join or a grouping
would drop anyway, so false hits cost work and never change a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(bits: int) -> tuple[int, ...]:
    """Offsets of the three bit fields of a key that place it in 2**bits bits."""
    return 0, (64 - bits) // 2, 64 - bits


def fixed_array(rows: DataFrame, size: int, dtype) -> np.ndarray:
    """A numpy array of fixed size from rows (place, value) of distinct places."""
    out = np.zeros(size, dtype)
    t = rows.toArrow()
    out[t.column(0).to_numpy()] = t.column(1).to_numpy().astype(dtype)
    return out


def build(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """The filter as 2**(bits - 6) words of 64 bits, gathered by aggregation."""
    low = F.lit((1 << bits) - 1)
    place = F.explode(F.array(*[F.shiftrightunsigned(key, f).bitwiseAND(low) for f in fields(bits)]))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    return fixed_array(words, 1 << (bits - 6), np.int64).view(np.uint64)


def hits(filled: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of the keys (uint64) the filter lets through."""
    out, one, low = np.ones(len(keys), bool), np.uint64(1), np.uint64((1 << bits) - 1)
    for f in fields(bits):
        p = (keys >> np.uint64(f)) & low
        out &= ((filled[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & one).astype(bool)
    return out
