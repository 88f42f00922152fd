"""Statistics of evaluations: intervals, agreement, precision and recall, thresholds, calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import ranks

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct<low, high> of the Wilson score interval of k successes in n; nulls for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    z2 = F.lit(z * z)
    base = F.lit(1.0) + F.try_divide(z2, n)
    mid = (p + F.try_divide(z2, 2 * n)) / base
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z2, 4 * n * n)) / base
    return F.struct(F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).alias("low"), F.when(n > 0, F.least(mid + half, F.lit(1.0))).alias("high"))


def rates(df: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """(keys..., n, k, rate, low, high)."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.coalesce(success, F.lit(False))).alias("k")).withColumn("__w", wilson(F.col("k"), F.col("n")))
    return g.select(*keys, "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round("__w.low", 6).alias("low"), F.round("__w.high", 6).alias("high"))


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys..., tp, fp, fn, tn, precision, recall, f1), percentages rounded to 2 places, 0 where undefined."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    g = df.groupBy(*(keys or [])).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    pct = lambda x, y: F.round(F.coalesce(F.try_divide(F.lit(100.0) * x, y), F.lit(0.0)), 2)
    return g.withColumn("precision", pct(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", pct(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", pct(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def mcnemar(df: DataFrame, first: Column, second: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys..., only_first, only_second, p): exact two-sided McNemar test of paired outcomes.

    The binomial tail runs over logarithms of factorials, so any number of discordant pairs works.
    """
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    g = df.groupBy(*(keys or [])).agg(F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))
    n, k = F.col("only_first") + F.col("only_second"), F.least("only_first", "only_second")
    # log of the binomial coefficient grows term by term: log C(n, i) = log C(n, i - 1) + log((n - i + 1) / i)
    step = lambda acc, i: F.struct((acc["c"] + F.log((n - i + 1) / i)).alias("c"), (acc["s"] + F.exp(acc["c"] + F.log((n - i + 1) / i) - n * F.log(F.lit(2.0)))).alias("s"))
    start = F.struct(F.lit(0.0).alias("c"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(upto, start, step)["s"]
    return g.withColumn("p", F.round(F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * tail, F.lit(1.0))), 6))


def kappa(df: DataFrame, first: str, second: str, keys: list[str] | None = None) -> DataFrame:
    """(keys..., n, agreement, kappa) of two raters; pairs with a missing rating are left out, kappa is 1 where chance explains everything."""
    keys = keys or []
    cells = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(*keys, F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*keys, F.col("a").alias("c")).agg(F.sum("n").alias("x"))
    right = cells.groupBy(*keys, F.col("b").alias("c")).agg(F.sum("n").alias("y"))
    chance = left.join(right, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("chance"))
    both = total.join(chance, keys, "left") if keys else total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return both.select(*keys, "n", F.round(po, 6).alias("agreement"), F.round(F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, id_col: str, resamples: int = 2000, seed: int = 0, error: float = 0.05) -> DataFrame:
    """(keys..., n, mean, low, high): 95 % interval of the mean by the Poisson bootstrap.

    Each row gets a Poisson(1) weight a resample from a hash of (seed, resample, id), so the weights do not depend on partitioning. All resamples of a
    row are drawn in one pass and added to the sums of its group: what is shuffled is resamples times groups, never rows.
    """
    group = (F.to_json(F.struct(*keys)) if keys else F.lit("")).alias("__g")
    rows = df.where(F.col(value).isNotNull()).select(*keys, group, F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(10)])
        offsets = _mixed(np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for g, x in held.items():
                yield pd.DataFrame({"__g": g, "r": np.arange(resamples), "s": x[0], "w": x[1]})

        for b in batches:
            for g, at in b.groupby("__g", sort=False).indices.items():
                sums = held.setdefault(g, np.zeros((2, resamples)))
                v, h = b["v"].to_numpy()[at], b["h"].to_numpy(np.int64).view(np.uint64)[at]
                for lo in range(0, len(v), 256):
                    bits = (_mixed(h[lo : lo + 256, None] + offsets) >> np.uint64(32)).astype(np.uint32)
                    weight = np.zeros(bits.shape, np.uint8)
                    for p in steps[steps < 1 - 2.0**-32]:
                        weight += bits >= np.uint32(p * 2.0**32)
                    sums += np.stack([v[lo : lo + 256], np.ones(len(bits))]) @ weight.astype(np.float64)
            if len(held) > 500:
                yield from flush()
                held.clear()
        yield from flush()

    sums = rows.select("__g", "v", "h").mapInPandas(draw, "__g string, r int, s double, w double").groupBy("__g", "r").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).where("w > 0")
    means = sums.groupBy("__g").agg(F.percentile(F.col("s") / F.col("w"), 0.025).alias("low"), F.percentile(F.col("s") / F.col("w"), 0.975).alias("high"))
    base = rows.groupBy("__g", *keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return base.join(means, "__g", "left").drop("__g")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def threshold_at(df: DataFrame, keys: list[str], score: str, benign: Column, fp: float) -> DataFrame:
    """(keys..., benign, threshold): the score above which at most a share ``fp`` of benign rows lies: with k = floor(fp n), the (k + 1)-th highest.

    Ranks come from counts a distinct score.
    """
    counts = df.where(benign & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("c"))
    r = ranks.cumulative(counts, keys, score, "c", descending=True).withColumnRenamed("upto", "above")
    need = F.least(F.floor(F.lit(fp) * F.col("total") + F.lit(1e-9)), F.col("total") - 1) + 1
    return r.groupBy(*keys).agg(F.max("total").alias("benign"), F.max(F.when(F.col("above") >= need, F.col(score))).alias("threshold"))


def calibrated(df: DataFrame, score: str, benign: Column, flag_fp: float, block_fp: float, alone_fp: float) -> DataFrame:
    """One row: flag <= block <= block_alone thresholds at their false-positive rates."""
    one = lambda fp, name: threshold_at(df, [], score, benign, fp).select(F.col("threshold").alias(name))
    t = one(flag_fp, "flag").crossJoin(one(block_fp, "block")).crossJoin(one(alone_fp, "block_alone"))  # single rows
    return t.select("flag", F.greatest("flag", "block").alias("block"), F.greatest("flag", "block", "block_alone").alias("block_alone"))


def cutoff_sweep(df: DataFrame, score: str, positive: Column, cutoffs: list[float]) -> DataFrame:
    """(cutoff, tp, fp, fn, tn, precision, recall, f1): every cut-off from one pass over the rows."""
    s = F.col(score)
    pos = F.coalesce(positive, F.lit(False))
    sums = df.agg(*[x for i, c in enumerate(cutoffs) for x in (F.count_if((s >= c) & pos).alias(f"tp{i}"), F.count_if((s >= c) & ~pos).alias(f"fp{i}"))], F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, c in enumerate(cutoffs)])
    r = sums.select("p", "n", F.explode(rows).alias("r")).select("r.*", (F.col("p") - F.col("r.tp")).alias("fn"), (F.col("n") - F.col("r.fp")).alias("tn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    return r.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def length_groups(counts: list[tuple[int, int]], fewest: int = 200) -> list[list[int]]:
    """Adjacent length buckets (bucket, benign rows) merged until each has ``fewest``; a short rest joins the last group. Buckets are a handful."""
    groups: list[list[int]] = []
    held, own = 0, []
    for bucket, n in sorted(counts):
        own.append(bucket)
        held += n
        if held >= fewest:
            groups.append(own)
            held, own = 0, []
    if own:
        if groups:
            groups[-1] += own
        else:
            groups.append(own)
    return groups


def owner_scores(segments: DataFrame, owner: str, score: str) -> DataFrame:
    """The highest score of each owner's segments."""
    return segments.groupBy(owner).agg(F.max(score).alias(score))


def span_hits(sentences: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Sentences (key, start, end) with ``labelled``: whether a label span (key, a, b) of the same key overlaps them."""
    near = sentences.join(labels, key).where("start < b and end > a").select(key, "start", "end").distinct().withColumn("labelled", F.lit(True))
    return sentences.join(near, [key, "start", "end"], "left").fillna(False, ["labelled"])


def facts_found(answer: Column, facts: Column) -> Column:
    """struct<found, wanted>: facts of which any alternative occurs in the answer, in any case."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    hit = F.filter(facts, lambda alternatives: F.exists(alternatives, lambda x: low.contains(F.lower(x))))
    return F.struct(F.coalesce(F.size(hit), F.lit(0)).alias("found"), F.coalesce(F.size(facts), F.lit(0)).alias("wanted"))
