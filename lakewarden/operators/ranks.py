"""Positions and cumulative counts within groups of any size, by range partitioning.

Rows are sorted into ranges by (keys, order); within a range a window runs, and the totals of the ranges before it give each range its offset. A group
that holds a third of all rows is spread over as many ranges as a third of the data has, and no task sees more than its range of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.runtime import cut

RANGE = "__range"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their range. The result is materialised, so that every use sees the same ranges."""
    return cut(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(RANGE, F.spark_partition_id()))


def same(keys: list[str], other: dict[str, str]) -> Column:
    """Null-safe equality of keys with the renamed ones of another frame."""
    found = F.lit(True)
    for k in keys:
        found &= F.col(k).eqNullSafe(F.col(other[k]))
    return found


def with_offsets(rows: DataFrame, keys: list[str], totals: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """Ranged rows joined with values of their group's earlier ranges.

    ``totals`` are aggregates a group and range; ``before`` are columns over them, evaluated on the window of the group's earlier ranges. The
    totals are one row a group and range it touches: groups plus ranges at most.
    """
    per = rows.groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in totals.items()])
    renamed = {k: f"__key{i}" for i, k in enumerate(keys)} | {RANGE: "__key_range"}
    offsets = per.select(*[F.col(k).alias(v) for k, v in renamed.items()], *[c.alias(n) for n, c in before.items()])
    return rows.join(offsets, same([*keys, RANGE], renamed)).drop(*renamed.values())


def earlier(keys: list[str]):
    """The window of a group's ranges before the current one."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a row a range
    return w.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def cumulative(counts: DataFrame, keys: list[str], value: str, n: str, descending: bool = False) -> DataFrame:
    """Counts (keys, value, n), one row a value, with ``upto``, the count of values up to this one (or from the top), and ``total``."""
    rows = ranged(counts, keys, [value])
    rows = with_offsets(rows, keys, {"__s": F.sum(n)}, {"__before": F.coalesce(F.sum("__s").over(earlier(keys)), F.lit(0)), "total": F.sum("__s").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))})
    run = F.sum(n).over(Window.partitionBy(*keys, RANGE).orderBy(value)) + F.col("__before")
    upto = F.col("total") - run + F.col(n) if descending else run
    return rows.withColumn("upto", upto).drop("__before", RANGE)


def numbered(df: DataFrame, keys: list[str], order: list[str], previous: str | None = None) -> DataFrame:
    """Rows with ``__n``, their position in their group from 0, and, if asked, ``__previous``: that column of the row before (it must be the
    first of ``order``). Rows equal in all of ``order`` are in any order."""
    rows = ranged(df, keys, order)
    totals = {"__c": F.count("*")} | ({"__m": F.max(previous)} if previous else {})
    before = {"__before": F.coalesce(F.sum("__c").over(earlier(keys)), F.lit(0))} | ({"__last": F.max("__m").over(earlier(keys))} if previous else {})
    rows = with_offsets(rows, keys, totals, before)
    w = Window.partitionBy(*keys, RANGE).orderBy(*order)
    if previous:
        rows = rows.withColumn("__previous", F.coalesce(F.lag(previous).over(w), F.col("__last"))).drop("__last")
    return rows.withColumn("__n", F.row_number().over(w) - 1 + F.col("__before")).drop("__before", RANGE)


def at_ranks(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys..., n, names...): for each name the value at that rank (from 1, a function of n) of each group's sorted values; nulls are left out.

    Ranks come from counts a value, so no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__count"))
    r = cumulative(counts, keys, value, "__count")
    return r.groupBy(*keys).agg(F.max("total").alias("n"), *[F.min(F.when(F.col("upto") >= rank(F.col("total")), F.col(value))).alias(name) for name, rank in wanted.items()])


def interpolated(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys..., n, names...): percentiles with linear interpolation between neighbouring ranks, as the built-in ``percentile`` gives."""
    ends = {f"__{side}{name}": (lambda q, up: lambda n: (F.ceil if up else F.floor)(F.lit(q) * (n - 1)) + 1)(q, side == "hi") for name, q in wanted.items() for side in ("lo", "hi")}
    r = at_ranks(df, keys, value, ends)
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return r.select(*keys, "n", *[(F.col(f"__lo{name}") + part(q) * (F.col(f"__hi{name}") - F.col(f"__lo{name}"))).alias(name) for name, q in wanted.items()])


def running(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Rows with the running sum of ``amount`` within their group up to and with the row; rows equal in all of ``order`` are in any order."""
    rows = ranged(df.withColumn("__amount", amount), keys, order)
    rows = with_offsets(rows, keys, {"__s": F.sum("__amount")}, {"__before": F.coalesce(F.sum("__s").over(earlier(keys)), F.lit(0))})
    upto = F.sum("__amount").over(Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, upto + F.col("__before")).drop("__before", "__amount", RANGE)
