"""Evidence trust: integrity against the registry, provenance, safety, tiers, order, contradictions and split payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions import text as tx

#: Trust of a source by its tier (fixed values).
SOURCE_SCORE = {"official": 1.0, "verified_internal": 0.9, "approved_external": 0.8, "unknown": 0.4, "untrusted": 0.1}


def source_score(tier: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_SCORE.items() for x in kv]), F.coalesce(tier, F.lit("unknown"))), F.lit(SOURCE_SCORE["unknown"]))


def content_key(chunk_uid: Column) -> Column:
    """The document hash of a chunk id ``<hash>_<n>``."""
    return F.regexp_replace(chunk_uid, r"_\d+$", "")


def with_registry(chunks: DataFrame, registry: DataFrame, chunk_uid: str = "chunk_uid", key: str = "content_hash") -> DataFrame:
    """Chunks with their registry entry's columns (prefixed ``registry_``), left join; the registry decides, not the chunk's own metadata."""
    named = registry.select([F.col(c).alias(f"registry_{c}") for c in registry.columns])
    return chunks.join(named, content_key(F.col(chunk_uid)) == F.col(f"registry_{key}"), "left")


def intact(content: Column, expected_sha256: Column) -> Column:
    """Content equal to the hash on record; a missing content or record fails closed."""
    return F.coalesce(F.sha2(content, 256) == expected_sha256, F.lit(False))


def provenance(score: Column, document_id: Column, version: Column, least: float = 0.60) -> Column:
    return score.isNotNull() & document_id.isNotNull() & version.isNotNull() & F.coalesce(score >= least, F.lit(False))


def safe(scan_status: Column, found: Column, anomaly: Column) -> Column:
    """struct<safe, risk>: quarantined 1.0, pattern hits 0.90, an anomaly of 0.3 or more itself."""
    a = F.coalesce(anomaly, F.lit(0.0))
    risk = F.when(F.coalesce(scan_status, F.lit("clean")) == "quarantined", F.lit(1.0)).when(F.size(found) > 0, F.lit(0.90)).when(a >= 0.3, a).otherwise(F.lit(0.0))
    return F.struct((risk == 0).alias("safe"), risk.alias("risk"))


def tier(authorized: Column, whole: Column, proven: Column, is_safe: Column, source_tier: Column) -> Column:
    """REJECT > QUARANTINE > TIER_3 (untrusted) > TIER_2 (no provenance or unknown) > TIER_1."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    src = F.coalesce(source_tier, F.lit("unknown"))
    return F.when(no(authorized) | no(whole), F.lit("REJECT")).when(no(is_safe), F.lit("QUARANTINE")).when(src == "untrusted", F.lit("TIER_3")).when(no(proven) | (src == "unknown"), F.lit("TIER_2")).otherwise(F.lit("TIER_1"))


def ordered(df: DataFrame, group: list[str], tier_col: str, score: str, tie: str, suspicious: Column | None = None) -> DataFrame:
    """Evidence with its place: tier 1 before 2 before 3, by score; tier 3 only where a group has neither 1 nor 2.

    Where ``suspicious`` holds, tiers 2 and 3 are set aside, unless the group has no tier 1. Rejected and quarantined rows are left out.
    """
    kept = df.where(F.col(tier_col).isin("TIER_1", "TIER_2", "TIER_3"))
    g = Window.partitionBy(*group)
    has = lambda *t: F.max(F.col(tier_col).isin(*t).cast("int")).over(g) == 1
    kept = kept.withColumn("__t1", has("TIER_1")).withColumn("__t12", has("TIER_1", "TIER_2"))
    if suspicious is not None:
        kept = kept.where(~(suspicious & F.col("__t1") & (F.col(tier_col) != "TIER_1")))
    kept = kept.where((F.col(tier_col) != "TIER_3") | ~F.col("__t12"))
    return kept.drop("__t1", "__t12").withColumn("place", F.row_number().over(g.orderBy(tier_col, F.desc_nulls_last(score), tie)))


def contradictions(unverified: DataFrame, trusted: DataFrame, group: str, item: str, text: str, own_share: float = 0.75, trusted_share: float = 0.5, fewest: int = 3) -> DataFrame:
    """(group, item, sentence, against): sentences of unverified passages that say what a trusted one says with other numbers or polarity.

    Both have at least ``fewest`` content words; the shared words are at least ``own_share`` of the sentence's and ``trusted_share`` of the trusted one's.
    Sentences meet on a shared word within their group. A sentence sharing 75 % of n words holds one of any n - ceil(0.75 n) + 1 of them: only those, the
    alphabetically first, are joined on, and nothing is lost.
    """

    def parts(df: DataFrame) -> DataFrame:
        s = df.select(group, item, F.explode(tx.sentences(F.col(text))).alias("s"))
        return s.select(group, item, "s", F.array_sort(tx.terms(F.col("s"), 3, letters_only=True)).alias("w"), tx.numbers(F.col("s")).alias("n"), tx.negations(F.col("s")).alias("neg")).where(F.size("w") >= fewest).distinct()

    u, t = parts(unverified), parts(trusted).drop(item).distinct()
    lead = F.slice("w", 1, (F.size("w") - F.ceil(F.size("w") * F.lit(own_share)) + 1).cast("int"))
    a = u.select("*", F.explode(lead).alias("key"))
    b = t.select(F.col(group), F.col("s").alias("ts"), F.col("w").alias("tw"), F.col("n").alias("tn"), F.col("neg").alias("tneg"), F.explode("w").alias("key"))
    shared = F.size(F.array_intersect("w", "tw"))
    near = (shared >= own_share * F.size("w")) & (shared >= trusted_share * F.size("tw"))
    differs = ((F.size("n") > 0) & (F.size("tn") > 0) & ~tx.contained(F.col("n"), F.col("tn"))) | (F.col("neg") != F.col("tneg"))
    return a.join(b, [group, "key"]).where(near & differs).groupBy(group, item, F.col("s").alias("sentence")).agg(F.min("ts").alias("against"))


def split_payloads(df: DataFrame, group: str, position: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(group, position, kept): passages in order, dropping those that complete a pattern neither the ones kept before nor they alone hold.

    The fold depends on its own decisions. Groups are kept together and in order and pass through one after the other, with the few passages of
    one answer as state.
    """
    kind = {c: t for c, t in df.dtypes}
    compiled = {k: re.compile(v, re.I | re.S | re.M) for k, v in patterns.items()}

    def found(t: str) -> set[str]:
        return {k for k, p in compiled.items() if p.search(t)}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept, before = None, [], set()
        for b in batches:
            flags = []
            for g, t in zip(b["__k"].tolist(), b[text].tolist()):
                if g != current:
                    current, kept, before = g, [], set()
                t = t if isinstance(t, str) else ""
                now = found(" ".join([*kept, t]))
                ok = not kept or not (now - before - found(t))
                if ok:
                    kept.append(t)
                    before = now
                flags.append(ok)
            yield b[[group, position]].assign(kept=flags)

    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("__k")
    rows = df.select(group, position, text, key).repartition(group).sortWithinPartitions(group, position)
    return rows.mapInPandas(fold, f"{group} {kind[group]}, {position} {kind[position]}, kept boolean")
