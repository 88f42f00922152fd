"""Reports over traces, screening results and answers: counts, shares, latencies, feedback, movements and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators import ranks


def outcome_shares(df: DataFrame, outcome: str) -> DataFrame:
    """(outcome, n, share); a missing outcome is "unknown"."""
    g = df.groupBy(F.coalesce(F.col(outcome), F.lit("unknown")).alias(outcome)).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row an outcome


def nearest_rank(value: str | Column, q: float) -> Column:
    """The smallest value with at least a share q of the values at or below it."""
    v = value if isinstance(value, str) else value
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {v})") if isinstance(v, str) else F.percentile(v, q)


def floor_index(df: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Percentiles as the element at index floor(q n) of the sorted values; ties and the last index are clipped. Ranks come from counts a value."""
    return _by_index(df, keys, value, quantiles, lambda n, q: F.least(F.floor(F.lit(q) * n), n - 1) + 1)


def rounded_index(df: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Percentiles as the element at index round(q (n - 1)), half up."""
    return _by_index(df, keys, value, quantiles, lambda n, q: F.floor(F.lit(q) * (n - 1) + 0.5) + 1)


def _by_index(df: DataFrame, keys: list[str], value: str, quantiles: list[float], rank) -> DataFrame:
    return ranks.at_ranks(df, keys, value, {f"p{q * 100:g}": (lambda q: lambda n: rank(n, q))(q) for q in quantiles})


def latency(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(keys..., n, p50, p95, p99, max) by nearest rank, and the same over everything under the key "total" (the first key's)."""
    rows = df.select(*keys, value)
    rows = rows.unionByName(df.select(F.lit("total").alias(keys[0]), *[F.lit(None).cast(dict(df.dtypes)[k]).alias(k) for k in keys[1:]], value))
    per = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.max(value).alias("max"))
    found = _by_index(rows, keys, value, list(quantiles), lambda n, q: F.greatest(F.ceil(F.lit(q) * n - 1e-9), F.lit(1))).drop("n")
    renamed = {k: f"__{k}" for k in keys}
    found = found.withColumnsRenamed(renamed)
    return per.join(found, ranks.same(keys, renamed), "left").select(*keys, "n", *[f"p{q * 100:g}" for q in quantiles], "max")


def stage_spans(traces: DataFrame, trace_id: str = "trace_id", spans: str = "spans", total: str = "total_ms") -> DataFrame:
    """(trace_id, stage, ms): the spans of traces and a synthetic "total" each."""
    s = traces.select(trace_id, F.explode(spans).alias("s")).select(trace_id, F.col("s.name").alias("stage"), F.col("s.duration_ms").alias("ms"))
    return s.unionByName(traces.select(trace_id, F.lit("total").alias("stage"), F.col(total).alias("ms")))


def stage_sums(traces: DataFrame, trace_id: str = "trace_id", spans: str = "spans", calls: str = "llm_calls") -> DataFrame:
    """One row a trace: time of its top-level stages (names without a dot), the slowest of them, and token totals; no shuffle."""
    top = F.filter(spans, lambda s: ~s["name"].contains("."))
    slow = F.array_max(F.transform(top, lambda s: F.struct(s["duration_ms"].alias("ms"), s["name"].alias("name"))))
    add = lambda field: F.aggregate(calls, F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c[field].cast("long"), F.lit(0)))
    return traces.select(trace_id, F.aggregate(top, F.lit(0.0), lambda a, s: a + F.coalesce(s["duration_ms"], F.lit(0.0))).alias("stage_ms"), slow["name"].alias("slowest_stage"), add("prompt_tokens").alias("prompt_tokens"), add("output_tokens").alias("output_tokens"))


def calls_by_purpose(traces: DataFrame, calls: str = "llm_calls") -> DataFrame:
    """(purpose, calls, failed, cut_off, median_ms)."""
    c = traces.select(F.explode(calls).alias("c")).select("c.*")
    return c.groupBy("purpose").agg(F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("done_reason") == "length").alias("cut_off"), nearest_rank("wall_ms", 0.5).alias("median_ms"))


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key by the given order (its last element decides ties)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def feedback_pivot(rated: DataFrame, outcome: str, rating: str, values: list[str]) -> DataFrame:
    """Outcome by rating, a column a rating value, 0 where there is none."""
    return rated.groupBy(outcome).pivot(rating, values).count().fillna(0, values)


def slowest(df: DataFrame, total: str, tie: str, n: int = 10) -> DataFrame:
    """The n slowest rows: a top-n per task and a merge, no full sort."""
    return df.orderBy(F.desc(total), tie).limit(n)


def limits_broken(df: DataFrame, value: str, limits: dict[float, float]) -> DataFrame:
    """One row: nearest-rank percentiles of ``value`` and the array of limits they exceed (limits: quantile -> most)."""
    names = {q: f"p{q * 100:g}" for q in limits}
    row = _by_index(df, [], value, list(limits), lambda n, q: F.greatest(F.ceil(F.lit(q) * n - 1e-9), F.lit(1))).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    over = F.array_compact(F.array(*[F.when(F.col(names[q]) > most, F.lit(names[q])) for q, most in limits.items()]))
    return row.withColumn("violations", F.array_join(over, ",")).withColumn("passed", F.size(over) == 0)


def grouping_report(df: DataFrame, dims: list[str], measures: dict[str, Column], sets: list[list[str]]) -> DataFrame:
    """Several groupings of one table in one pass (GROUPING SETS); rolled-up dimensions are "all", missing values "unknown"."""
    shown = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dims], *[m.alias(k) for k, m in measures.items()])
    out = shown.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), *[F.round(F.avg(k), 6).alias(k) for k in measures])
    return out.fillna("all", dims)
