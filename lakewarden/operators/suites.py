"""Roll-ups of evaluation runs: screening, answers, poisoned documents, adaptive sessions, attacker campaigns, judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators import evaluation, ranks


def screening(results: DataFrame, config: str, family: str, is_attack: Column, action: str) -> DataFrame:
    """(config, family, n, flagged, blocked): shares flagged or blocked and blocked, a configuration and family, and "all" families."""
    r = results.select(config, F.when(is_attack, F.coalesce(F.col(family), F.lit("unknown"))).otherwise(F.lit("benign")).alias(family), F.when(is_attack, "all attacks").otherwise("all benign").alias("__all"), action)
    rows = r.select(config, F.explode(F.array(F.col(family), F.col("__all"))).alias(family), action)
    return rows.groupBy(config, family).agg(F.count("*").alias("n"), F.round(F.avg((F.col(action) != "PASS").cast("int")), 6).alias("flagged"), F.round(F.avg((F.col(action) == "BLOCK").cast("int")), 6).alias("blocked"))


def answers(results: DataFrame, config: str, answer: str, facts: str, wrong: str, abstained: Column) -> DataFrame:
    """(config, n, fact_recall, all_facts, wrong_claims, abstentions) of answers against their gold facts and known wrong claims."""
    f = evaluation.facts_found(F.col(answer), F.col(facts))
    low = F.lower(F.coalesce(F.col(answer), F.lit("")))
    bad = F.coalesce(F.exists(F.col(wrong), lambda w: low.contains(F.lower(w))), F.lit(False))
    r = results.select(config, f.alias("f"), bad.alias("bad"), abstained.alias("ab"))
    recall = F.try_divide(F.sum("f.found"), F.sum("f.wanted"))
    return r.groupBy(config).agg(F.count("*").alias("n"), F.round(recall, 6).alias("fact_recall"), F.round(F.avg((F.col("f.found") == F.col("f.wanted")).cast("int")), 6).alias("all_facts"), F.count_if("bad").alias("wrong_claims"), F.count_if(F.coalesce("ab", F.lit(False))).alias("abstentions"))


def poisoning(results: DataFrame, condition: str, style: str, success: Column, seen: Column) -> DataFrame:
    """(condition, style, n, k, rate, low, high, seen): attack success with its interval, and how often the poison was seen, also over all styles."""
    r = results.select(condition, F.explode(F.array(F.col(style), F.lit("all"))).alias(style), success.alias("__s"), seen.alias("__p"))
    base = evaluation.rates(r, [condition, style], F.col("__s"))
    return base.join(r.groupBy(condition, style).agg(F.count_if(F.coalesce("__p", F.lit(False))).alias("seen")), [condition, style])


def head_to_head(results: DataFrame, case: str, condition: str, success: Column, first: str, second: str) -> DataFrame:
    """One row: exact McNemar test of two conditions over the cases both ran."""
    r = results.withColumn("__s", success)
    a = r.where(F.col(condition) == first).groupBy(case).agg(F.bool_or("__s").alias("a"))
    b = r.where(F.col(condition) == second).groupBy(case).agg(F.bool_or("__s").alias("b"))
    return evaluation.mcnemar(a.join(b, case), F.col("a"), F.col("b"))


def campaigns(attempts: DataFrame, attack: str, attempt: str, action: str, budgets: list[int]) -> DataFrame:
    """(budget, attacks, undetected, blocked, release_share): attackers with so many attempts each; one pass, a row a budget."""
    n = F.row_number().over(Window.partitionBy(attack).orderBy(attempt))
    a = attempts.withColumn("__n", n)
    per = a.groupBy(attack).agg(*[x for b in budgets for x in (F.bool_or((F.col("__n") <= b) & (F.col(action) == "PASS")).alias(f"u{b}"), F.bool_or((F.col("__n") <= b) & (F.col(action) == "BLOCK")).alias(f"k{b}"), F.count_if((F.col("__n") <= b) & (F.col(action) != "BLOCK")).alias(f"r{b}"), F.count_if(F.col("__n") <= b).alias(f"t{b}"))])
    one = per.agg(F.count("*").alias("attacks"), *[x for b in budgets for x in (F.count_if(f"u{b}").alias(f"u{b}"), F.count_if(f"k{b}").alias(f"k{b}"), F.sum(f"r{b}").alias(f"r{b}"), F.sum(f"t{b}").alias(f"t{b}"))])
    rows = F.array(*[F.struct(F.lit(b).alias("budget"), F.col("attacks"), F.col(f"u{b}").alias("undetected"), F.col(f"k{b}").alias("blocked"), F.round(F.try_divide(F.col(f"r{b}"), F.col(f"t{b}")), 6).alias("release_share")) for b in budgets])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def drop_causes(claims: DataFrame, causes: list[tuple[str, Column]], keys: list[str] | None = None) -> DataFrame:
    """(keys..., cause, n, share): each dropped claim under the first cause that holds, "other" if none does."""
    keys = keys or []
    cause = F.lit("other")
    for name, holds in reversed(causes):
        cause = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(cause)
    g = claims.groupBy(*keys, cause.alias("cause")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a row a cause
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(whole), 6))


def judges(claims: DataFrame, judge: DataFrame, human: DataFrame, key: str, verdict: str) -> DataFrame:
    """(pair, n, agreement, kappa): system, judge and human verdicts (booleans) of the same claims, pair by pair."""
    j = claims.select(key, F.col(verdict).alias("system")).join(judge.select(key, F.col(verdict).alias("judge")), key).join(human.select(key, F.col(verdict).alias("human")), key)
    out = None
    for a, b in (("system", "judge"), ("system", "human"), ("judge", "human")):
        one = evaluation.kappa(j, a, b).select(F.lit(f"{a}-{b}").alias("pair"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def unsupported(sentences: DataFrame, answer: str, bad: Column) -> DataFrame:
    """One row: sentences, unsupported ones, their pooled share, and the mean of the shares an answer."""
    per = sentences.groupBy(answer).agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("k"))
    return per.agg(F.sum("n").alias("sentences"), F.sum("k").alias("unsupported"), F.round(F.try_divide(F.sum("k"), F.sum("n")), 6).alias("pooled"), F.round(F.avg(F.col("k") / F.col("n")), 6).alias("per_answer"))


def grounding(results: DataFrame, answer: str, status: str) -> DataFrame:
    """(answer, claims, verified, contradicted, ratio)."""
    g = results.groupBy(answer).agg(F.count("*").alias("claims"), F.count_if(F.col(status) == "ENTAILMENT").alias("verified"), F.count_if(F.col(status) == "CONTRADICTION").alias("contradicted"))
    return g.withColumn("ratio", F.round(F.col("verified") / F.col("claims"), 6))


def component_latency(df: DataFrame, component: str, ms: str) -> DataFrame:
    """(component, runs, mean, spread, p50, p95, p99) with interpolated percentiles; a component without a time has null ones."""
    per = df.groupBy(component).agg(F.count(ms).alias("runs"), F.round(F.avg(ms), 4).alias("mean"), F.round(F.stddev_pop(ms), 4).alias("spread"))
    picks = {f"p{q * 100:g}": q for q in (0.5, 0.95, 0.99)}
    found = ranks.interpolated(df.select(component, F.col(ms).cast("double").alias(ms)), [component], ms, picks).withColumnRenamed(component, "__c")
    return per.join(found, ranks.same([component], {component: "__c"}), "left").select(component, "runs", "mean", "spread", *[F.round(p, 4).alias(p) for p in picks])


def interval_text(mean: Column, low: Column, high: Column, places: int = 1) -> Column:
    """A mean with its interval, in percent: ``46.7 [38.0, 55.6]``."""
    p = lambda c: F.format_string(f"%.{places}f", c * 100)
    return F.concat(p(mean), F.lit(" ["), p(low), F.lit(", "), p(high), F.lit("]"))
