"""Poisoning scans of a corpus: pattern feed, outlying embeddings, combined status and its propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators import ranks
from lakewarden.runtime import cut

FLAG_AT, QUARANTINE_AT = 0.3, 0.8


def hits(text: Column, feed: dict[str, tuple[float, str]], least: float = 0.0) -> Column:
    """array<struct<id, severity>> of the feed's patterns (id -> (severity, regex)) found in a text.

    The feed is unrolled into one expression: a scan of the text a pattern, no join. Patterns match in any case, over lines, Unicode-aware.
    """
    t = F.coalesce(text, F.lit(""))
    found = [F.when(t.rlike("(?ismu)" + regex), F.struct(F.lit(i).alias("id"), F.lit(float(s)).alias("severity"))) for i, (s, regex) in feed.items() if s >= least]
    empty = F.array().cast("array<struct<id:string,severity:double>>")
    return F.array_compact(F.array(*found)) if found else empty


CLAIMED = r"(?i)\b(?:i am|i'm|as) (?:an?|the|your) (?:admin(?:istrator)?|developer|owner|manager|engineer|auditor|supervisor)\b|\b(?:authori[sz]ed|approved|cleared) by\b|\bmy (?:manager|supervisor|admin)\b"
ADMIN_CLAIM = r"(?i)\b(?:i am|i'm|as) (?:an?|the|your) (?:super ?)?admin(?:istrator)?\b"
PROTECTED = r"(?i)\b(?:passwords?|credentials?|secrets?|system prompt|other tenants?|salar(?:y|ies)|bypass|disable|full access|all (?:records|documents|files))\b"


def authority(text: Column, role: Column | None = None) -> Column:
    """Risk of a claimed authority: 0.45 if a claim and a protected target stand in one sentence or in neighbouring ones, 0.65 if the claim is
    of being an administrator by one who is not; administrators are exempt. Null and empty texts score 0."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    at = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)))
    near = F.transform(at, lambda i: F.array_join(F.slice(pieces, i, 2), " "))
    claimed = F.exists(near, lambda p: p.rlike(CLAIMED) & p.rlike(PROTECTED))
    as_admin = F.exists(near, lambda p: p.rlike(ADMIN_CLAIM) & p.rlike(PROTECTED))
    score = F.when(as_admin, F.lit(0.65)).when(claimed, F.lit(0.45)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(F.lower(role).isin("admin", "super_admin"), F.lit(False)), F.lit(0.0)).otherwise(score) if role is not None else score


def joined_best(df: DataFrame, owner: str, position: str, text: str, score: str, k: int = 3) -> DataFrame:
    """(owner, joined): the k highest-scoring pieces of a message, joined in reading order; ties go to the earlier piece."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(score), position))
    top = df.withColumn("__r", rank).where(F.col("__r") <= k)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])  # k at most
    return top.groupBy(owner).agg(F.array_join(parts, " ").alias("joined"))


def severity(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda h: h["severity"])), F.lit(0.0))


def instruction_score(found: Column, verdict: Column | None = None, confidence: Column | None = None) -> Column:
    """Highest severity; a judge's confirmation raises it to the confidence, a clearance lowers it to 0.3 of it."""
    s = severity(found)
    if verdict is None:
        return s
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(verdict.isNull(), s).when(verdict, F.greatest(s, c)).otherwise(s * 0.3)


def outliers(df: DataFrame, group: str, item: str, vector: str, fewest: int = 5) -> DataFrame:
    """(group, item, distance, z, score): how far each vector lies from its group's centroid, by robust z of cosine distances.

    z = (d - median) / (1.4826 MAD), score = 0.6 clip((z - 2) / 4). Groups below ``fewest`` vectors, or with a MAD below 1e-9, score 0. Centroids are
    averaged dimension by dimension and medians ranked over ranges, so no task holds a group of any size; null vectors are left out.
    """
    rows = df.select(group, item, F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).where("v is not null")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-12)
    rows = rows.withColumn("v", F.transform("v", lambda x: x / length))
    dims = rows.select(group, F.posexplode("v").alias("d", "x")).groupBy(group, "d").agg(F.avg("x").alias("x"))
    centre = dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))  # one number a dimension
    dot = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-12)
    far = cut(rows.join(centre, group).select(group, item, (F.lit(1.0) - dot / size).alias("distance")))
    mid = ranks.interpolated(far, [group], "distance", {"m": 0.5})
    off = far.join(mid.select(group, "m"), group).select(group, F.abs(F.col("distance") - F.col("m")).alias("off"))
    spread = mid.join(ranks.interpolated(off, [group], "off", {"mad": 0.5}).select(group, "mad"), group)
    out = far.join(spread, group)
    flat = (F.col("n") < fewest) | (F.col("mad") < 1e-9)
    z = F.when(flat, F.lit(0.0)).otherwise((F.col("distance") - F.col("m")) / (F.lit(1.4826) * F.col("mad")))
    return out.withColumn("z", z).select(group, item, "distance", "z", (F.lit(0.6) * F.least(F.greatest((F.col("z") - 2) / 4, F.lit(0.0)), F.lit(1.0))).alias("score"))


def status(instruction: Column, embedding: Column) -> Column:
    """quarantined, flagged or clean by the larger of the two scores."""
    a = F.greatest(F.coalesce(instruction, F.lit(0.0)), F.coalesce(embedding, F.lit(0.0)))
    return F.when(a >= QUARANTINE_AT, F.lit("quarantined")).when(a >= FLAG_AT, F.lit("flagged")).otherwise(F.lit("clean"))


def propagated(df: DataFrame, parent: str, column: str = "scan_status") -> DataFrame:
    """A quarantined member quarantines all rows of its parent; an empty parent is none."""
    key = F.when(F.col(parent) != "", F.col(parent))
    bad = F.max((F.col(column) == "quarantined").cast("int")).over(Window.partitionBy(key))
    return df.withColumn(column, F.when(key.isNotNull() & (bad == 1), F.lit("quarantined")).otherwise(F.col(column)))
