"""Logic with state a key: suspicion with decay, token buckets, lock-outs, token rotation, first events of sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators import ranks

ALPHA, HALF_LIFE_S = 0.5, 600.0
CLEAN_RISK, CLEAN_RELAX, RISK_FLOOR, RISK_SPAN = 0.20, 0.95, 0.20, 0.60


def evidence_of(risk: Column, blocked: Column | None = None, weight: Column | None = None) -> Column:
    """Evidence of a screened message: 1 if blocked, null for a clean turn, else the risk above the floor, weighted."""
    e = (risk - F.lit(RISK_FLOOR)) / F.lit(RISK_SPAN)
    e = F.least(F.greatest(e * (weight if weight is not None else F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    clean = F.when(risk < CLEAN_RISK, F.lit(None).cast("double")).otherwise(e)
    return F.when(F.coalesce(blocked, F.lit(False)), F.lit(1.0)).otherwise(clean) if blocked is not None else clean


#: Events a block; blocks are grouped by the same factor on each level.
STEPS = 64
LEVELS = 2


def _composed(parts: Column) -> Column:
    """Affine steps s -> m s + c, in order, as one step."""
    step = lambda acc, x: F.struct((acc["m"] * x["m"]).alias("m"), (acc["c"] * x["m"] + x["c"]).alias("c"))
    return F.aggregate(parts, F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("c")), step)


def _starts(steps: DataFrame, level: int) -> DataFrame:
    """(key, n, s0): the state before each step of (key, n, m, c), n counting from 0 a key."""
    if level == 0:
        before = F.collect_list(F.struct("m", "c")).over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
        return steps.select("key", "n", _composed(before)["c"].alias("s0"))
    rows = steps.withColumn("g", F.floor(F.col("n") / STEPS))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "m", "c"))), lambda x: F.struct(x["m"], x["c"]))  # STEPS at most
    groups = rows.groupBy("key", F.col("g")).agg(_composed(ordered).alias("t")).select("key", F.col("g").alias("n"), "t.m", "t.c")
    first = _starts(groups, level - 1).select(F.col("key").alias("gk"), F.col("n").alias("gn"), F.col("s0").alias("gs"))
    inside = F.collect_list(F.struct("m", "c")).over(Window.partitionBy("key", "g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("t", _composed(inside)).join(first, F.col("key").eqNullSafe(F.col("gk")) & (F.col("g") == F.col("gn")))
    return joined.select("key", "n", (F.col("gs") * F.col("t.m") + F.col("t.c")).alias("s0"))


def suspicion(events: DataFrame, key: str, ts_seconds: str, evidence: str, tie: str, alpha: float = ALPHA, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """Events with the suspicion of their key before and after them.

    s decays by half every ``half_life_s``; evidence e in [0, 1] raises it to s + (1 - s) alpha e, a clean turn (null evidence) multiplies it by 0.95.
    Each step is affine, s' = m s + c, so steps compose: blocks of STEPS events are folded on their own, blocks of blocks likewise, and the states at
    block starts are handed down. The result is that of the sequential fold, but no task folds more than STEPS events or the few top blocks of a key.
    """
    rows = ranks.numbered(events, [key], [ts_seconds, tie], previous=ts_seconds)
    gap = F.greatest(F.col(ts_seconds) - F.col("__previous"), F.lit(0.0))
    e = F.least(F.greatest(F.col(evidence).cast("double"), F.lit(0.0)), F.lit(1.0))
    clean = F.col(evidence).isNull()
    rows = rows.withColumn("__d", F.coalesce(F.pow(F.lit(2.0), -gap / F.lit(half_life_s)), F.lit(1.0)))
    rows = rows.withColumn("__m", F.when(clean, F.lit(CLEAN_RELAX)).otherwise(1 - F.lit(alpha) * e) * F.col("__d")).withColumn("__c", F.when(clean, F.lit(0.0)).otherwise(F.lit(alpha) * e))
    first = _starts(rows.select(F.col(key).alias("key"), F.col("__n").alias("n"), F.col("__m").alias("m"), F.col("__c").alias("c")), LEVELS)
    out = rows.join(first.select(F.col("key").alias("__k"), F.col("n").alias("__i"), F.col("s0").alias("__s")), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__n") == F.col("__i")))
    return out.withColumn("suspicion_before", F.col("__s") * F.col("__d")).withColumn("suspicion_after", F.col("__s") * F.col("__m") + F.col("__c")).drop("__d", "__n", "__m", "__c", "__k", "__i", "__s", "__previous")


def thresholds(s: Column) -> Column:
    """struct<block, flag, entailment>: how suspicion tightens the thresholds."""
    return F.struct(F.greatest(F.lit(0.45), F.lit(0.80) - F.lit(0.50) * s).alias("block"), F.greatest(F.lit(0.15), F.lit(0.30) - F.lit(0.15) * s).alias("flag"), (F.lit(0.60) + F.lit(0.10) * s).alias("entailment"))


def action(base_risk: Column, policy: Column) -> Column:
    return F.when(base_risk >= policy["block"], F.lit("BLOCK")).when(base_risk >= policy["flag"], F.lit("FLAG")).otherwise(F.lit("PASS"))


def token_bucket(events: DataFrame, key: str, ts_seconds: str, tie: str, capacity: float = 60.0, refill: float = 1.0) -> DataFrame:
    """Events with ``allowed`` and the tokens left: a bucket of ``capacity`` refilled at ``refill`` a second, one token an admitted event.

    Whether an event is admitted depends on all decisions before it since the bucket was last full. It is full again after a gap of
    capacity / refill seconds, whatever happened, so each key is cut there into sessions that are folded on their own. Cuts are found over ranges of
    a key's events, so a key that holds a third of them is no single task.
    """
    found = ranks.numbered(events, [key], [ts_seconds, tie], previous=ts_seconds)
    gap = F.col(ts_seconds) - F.col("__previous")
    rows = ranks.running(found.withColumn("__cut", F.coalesce((gap >= capacity / refill).cast("int"), F.lit(1))).drop("__n", "__previous"), [key], [ts_seconds, tie], F.col("__cut"), "__s").drop("__cut")
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("tokens_left", T.DoubleType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, tokens, last = None, capacity, 0.0
        for b in batches:
            allowed, left = [], []
            for k, n, t in zip(b["__k"].tolist(), b["__s"].tolist(), b[ts_seconds].tolist()):
                if session != (k, n):  # the first event of a session finds a full bucket
                    session, tokens, last = (k, n), capacity, t
                tokens = min(capacity, tokens + max(0.0, t - last) * refill)
                ok = tokens >= 1
                tokens -= ok
                last = t
                allowed.append(ok)
                left.append(tokens)
            yield b.drop(columns=["__s", "__k"]).assign(allowed=allowed, tokens_left=left)

    # sessions are kept together and in order, and pass through the fold one after the other with a state of two numbers
    apart = rows.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))).repartition(key, "__s").sortWithinPartitions(key, "__s", ts_seconds, tie)
    return apart.mapInPandas(fold, schema)


def lockouts(failures: DataFrame, key: list[str], ts_seconds: str, limit: int = 5, window_s: int = 900) -> DataFrame:
    """Failures with their number within the window before them, whether the key is locked then, and until when."""
    w = Window.partitionBy(*key).orderBy(F.col(ts_seconds).cast("long"))
    recent = F.count("*").over(w.rangeBetween(-window_s + 1, 0))
    fifth = F.lag(ts_seconds, limit - 1).over(Window.partitionBy(*key).orderBy(ts_seconds))
    return failures.withColumn("recent", recent).withColumn("locked", F.col("recent") >= limit).withColumn("locked_until", F.when(F.col("recent") >= limit, fifth + window_s))


def reused_tokens(uses: DataFrame, family: str, token: str, ts: str) -> DataFrame:
    """(family, revoked_at): token families revoked by the second use of a single-use token, at the first such use."""
    n = F.row_number().over(Window.partitionBy(family, token).orderBy(ts))
    return uses.withColumn("__n", n).where("__n = 2").groupBy(family).agg(F.min(ts).alias("revoked_at"))


def sessions(turns: DataFrame, session: str, turn: str, action_col: str, budget: int = 20) -> DataFrame:
    """One row a session: turns, released, first blocked turn, and whether one within ``budget`` turns went undetected."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(turn))
    t = turns.withColumn("__n", n)
    return t.groupBy(session).agg(F.count("*").alias("turns"), F.count_if(F.col(action_col) != "BLOCK").alias("released"), F.min(F.when(F.col(action_col) == "BLOCK", F.col("__n"))).alias("first_block"), F.bool_or((F.col("__n") <= budget) & (F.col(action_col) == "PASS")).alias("undetected_within_budget"))
