"""Filters of a fixed size: whether a hash may be among those of another table, whatever the size of either."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """2 ** bits bits (bits in 12..31) with two set for each value of a 64-bit hash column; null sets none.

    The result has 2 ** (bits - 3) bytes however many values there are: with more values it lets more through, and never holds back one that is there.
    It is made of at most 2 ** (bits - 6) rows that combine before they are shuffled.
    """
    mask = (1 << bits) - 1
    both = df.where(F.col(column).isNotNull()).select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))).alias("p"))
    rows = both.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).view(np.uint64)
    return out


def among(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each 64-bit value whether it may be among those the bitmap was made of."""
    mask = np.uint64(len(filter_) * 64 - 1)
    v = values.view(np.uint64)
    found = np.ones(v.shape, bool)
    for p in (v & mask, (v >> np.uint64(32)) & mask):
        found &= ((filter_[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found
