"""Filters of a bounded number of bits over 64-bit hashes: a set bit may lie, a clear one never does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, within the bounds. Beyond the upper one the filter lets more through, and never less.
BITS_A_KEY = 16
MIN_BITS, MAX_BITS = 16, 28


def bits_for(n: int) -> int:
    return min(max((BITS_A_KEY * n).bit_length(), MIN_BITS), MAX_BITS)


def build(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of the long column, at its upper `bits` bits: 2^bits bits, whatever keys holds."""
    at = keys.select(F.shiftrightunsigned(column, 64 - bits).alias("at"))
    bit = at.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("b"))
    found = bit.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2^(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def has(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned values may be keys."""
    bits = len(filter_).bit_length() + 5
    at = values >> np.uint64(64 - bits)
    return (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
