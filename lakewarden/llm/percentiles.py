"""Percentiles of very large numeric columns from cumulative frequencies, mergeable and with a bounded relative error.

A value v > 0 is reduced to its bucket ``ceil(ln v / ln g)`` with ``g = (1 + e) / (1 - e)``; the bucket's representative
``2 g^i / (g + 1)`` is within a fraction ``e`` of every value in it. Counts per group and bucket are the mergeable summary: those of days or
partitions add up to those of longer spans. With ``error=None`` the values themselves are counted and results are exact.

Percentiles come from the counts by cumulative frequencies: the value axis of each group is range-partitioned into blocks, window sums run
inside blocks, block totals give the offsets, and the first bucket whose cumulative count reaches ``ceil(q n)`` is picked (nearest rank).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.runtime import cut

#: Buckets in one block of the value axis; at an error of 1 % a block spans a factor of about 3.6.
BLOCK = 64


def growth(error: float) -> float:
    return (1 + error) / (1 - error)


def valid(value: Column, lowest: float = 0.0) -> Column:
    """A usable measurement: neither null, NaN, infinite nor impossible (at or below ``lowest``)."""
    return value.isNotNull() & ~F.isnan(value) & (value > F.lit(float(lowest))) & (value < F.lit(float("inf")))


def summary(df: DataFrame, keys: list[str], value: str, error: float | None = 0.01, lowest: float = 0.0) -> DataFrame:
    """(keys..., bucket, n): the mergeable counts of valid values.

    Null keys form a group of their own. Null, NaN, infinite and impossible values are left out; a group with no valid value has no row.
    Counting combines on the map side, so a group holding most rows shuffles only its distinct buckets.
    """
    v = F.col(value).cast("double")
    bucket = F.ceil(F.log(v) / F.lit(math.log(growth(error)))).cast("double") if error else v
    return df.where(valid(v, lowest)).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of days or partitions (a union, or one with finer keys) combined into those of ``keys``."""
    return counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: list[str], quantiles: list[float], error: float | None = 0.01) -> DataFrame:
    """(keys..., n, p50, p95, ...): nearest-rank percentiles of each group from its counts.

    A percentile is within a fraction ``error`` of the exact nearest-rank value (exact for ``error=None``); ties need no rule, as equal
    values share a bucket. The counts are made once and kept in the checkpoint folder, as offsets and running sums both read them. Clashing names do not arise, as only ``keys``, bucket and n are read. An empty summary gives no rows.
    """
    if error:
        block = F.floor(F.col("bucket") / F.lit(float(BLOCK)))
    else:  # order-preserving and fine enough for any spread: 64 blocks a factor of e
        block = F.when(F.col("bucket") > 0, F.floor(F.log("bucket") * F.lit(float(BLOCK)))).otherwise(-F.floor(F.log1p(-F.col("bucket")) * F.lit(float(BLOCK))) - F.lit(10**6))
    rows = cut(counts.select(*keys, "bucket", "n", block.cast("long").alias("block")))
    totals = rows.groupBy(*keys, "block").agg(F.sum("n").alias("block_n"))
    ordered = Window.partitionBy(*keys).orderBy("block")
    # one row a group and block: the offsets are small however many values a group has
    offsets = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("block").alias("__block"), (F.sum("block_n").over(ordered) - F.col("block_n")).alias("before"), F.sum("block_n").over(Window.partitionBy(*keys)).alias("total"))
    ranks = {q: F.greatest(F.ceil(F.lit(float(q)) * F.col("total") - F.lit(1e-9)), F.lit(1)) for q in quantiles}
    same = F.col("block") == F.col("__block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, "block").orderBy("bucket")
    upto = rows.withColumn("running", F.sum("n").over(inside)).join(offsets, same).withColumn("cum", F.col("before") + F.col("running"))
    g = growth(error) if error else None
    shown = (F.pow(F.lit(g), F.col("bucket")) * F.lit(2 / (g + 1))) if error else F.col("bucket")
    return upto.groupBy(*keys).agg(F.max("total").alias("n"), *[F.min(F.when(F.col("cum") >= ranks[q], shown)).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles])
