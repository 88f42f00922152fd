"""Composed pipelines: ingestion, screening, evidence and answer verification. Models are parameters; without one, its step is left out.

A cheap native filter stands before each model step by splitting the frame: a CASE would not keep a Python function from running on every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import masking
from lakewarden.functions import text as tx
from lakewarden.functions import vectors as vx
from lakewarden.functions.decoding import decoded
from lakewarden.operators import chunking, filters, scan, search, state, store, trust, verify
from lakewarden.plans.feed import BUILT_IN, FEED

Model = Callable[[Column], Column]


def ingest(files: DataFrame, registry: DataFrame, embed: Model | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, deep_tiers: tuple[str, ...] = ("unknown", "untrusted")) -> DataFrame:
    """Chunks of new documents, scanned and with their version: files are (content_hash, tenant_id, document_id, source_tier, ingested_at, content).

    Known contents are skipped before anything expensive. Patterns run on the normalised text. ``judge`` gets the chunks with hits (all chunks of
    the ``deep_tiers``) and adds ``verdict`` and ``confidence``; ``embed`` turns a text into a vector for the outlier scan.
    """
    fresh = store.missing(files, registry, "content_hash").join(files, "content_hash")
    fresh = store.next_versions(fresh, registry)
    parts = chunking.chunks(fresh, "content_hash", "content").join(fresh.drop("content"), "content_hash")
    parts = parts.withColumn("hits", scan.hits(tx.for_scan(F.col("content")), FEED))
    if judge is not None:
        asked = (F.size("hits") > 0) | F.col("source_tier").isin(list(deep_tiers))
        parts = judge(parts.where(asked)).unionByName(parts.where(~asked).withColumn("verdict", F.lit(None).cast("boolean")).withColumn("confidence", F.lit(None).cast("double")))
        parts = parts.withColumn("instr_score", scan.instruction_score(F.col("hits"), F.col("verdict"), F.col("confidence")))
    else:
        parts = parts.withColumn("instr_score", scan.instruction_score(F.col("hits")))
    if embed is not None:
        parts = parts.withColumn("embedding", embed(F.col("content")))
        far = scan.outliers(parts, "content_hash", "chunk_uid", "embedding").select("chunk_uid", F.col("score").alias("embed_score"))
        parts = parts.join(far, "chunk_uid", "left").fillna(0.0, ["embed_score"])
    else:
        parts = parts.withColumn("embed_score", F.lit(0.0))
    parts = parts.withColumn("anomaly_score", F.round(F.greatest("instr_score", "embed_score"), 3))
    return parts.withColumn("scan_status", scan.status(F.col("instr_score"), F.col("embed_score")))


def screen(messages: DataFrame, key: str, ts: str, message_id: str, text: str, classifier: Model | None = None, role: str | None = None) -> DataFrame:
    """Messages with detector scores, base risk, the suspicion of their key before them and the action under it.

    H: highest severity of a pattern in the decoded, normalised text; A: an authority claim and a protected target in neighbouring sentences; C: a
    classifier's probability, if there is one. The action of a message feeds the suspicion of later ones: evidence comes from the base risk under the
    resting thresholds, so that the fold stays one pass.
    """
    m = messages.withColumn("__d", decoded(F.col(text)))
    m = m.withColumn("processed", tx.for_scan(F.col("__d.text"))).withColumn("encoding_anomaly", F.col("__d.anomaly")).drop("__d")
    h = scan.severity(scan.hits(F.col("processed"), FEED))
    m = m.withColumn("h", F.greatest(h, F.when(F.col("encoding_anomaly"), F.lit(0.5)).otherwise(0.0))).withColumn("a", scan.authority(F.col("processed"), F.col(role) if role else None))
    m = m.withColumn("c", classifier(F.col("processed")) if classifier is not None else F.lit(0.0))
    m = m.withColumn("refused", filters.admission(F.col(text))).withColumn("base_risk", F.when(F.col("refused").isNotNull(), F.lit(0.0)).otherwise(F.greatest("h", "a", "c")))
    m = m.withColumn("__e", F.when(F.col("refused").isNotNull(), F.lit(0.3)).otherwise(state.evidence_of(F.col("base_risk"), F.col("base_risk") >= 0.80)))
    out = state.suspicion(m, key, ts, "__e", message_id).drop("__e")
    policy = state.thresholds(F.col("suspicion_before"))
    return out.withColumn("action", F.when(F.col("refused").isNotNull(), F.lit("BLOCK")).otherwise(state.action(F.col("base_risk"), policy)))


def hybrid(queries: DataFrame, chunks: DataFrame, tenant: str, clearance: int, k: int, query_id: str, query_text: str, query_vec: str, chunk_id: str, chunk_text: str, chunk_vec: str) -> DataFrame:
    """(query_id, content, score, rank): dense and keyword retrieval over what the asker may see, fused; filters reach the scan of either side."""
    seen = filters.visible(chunks, tenant, clearance)
    dense = search.nearest(queries, seen, 2 * k, query_id, chunk_id, query_vec, chunk_vec).join(seen.select(chunk_id, F.col(chunk_text).alias("content")), chunk_id)
    words = search.bm25(queries, seen, 2 * k, query_id, query_text, chunk_id, chunk_text).join(seen.select(chunk_id, F.col(chunk_text).alias("content")), chunk_id)
    return search.fused(dense, words, query_id, "content", k)


def evidence(candidates: DataFrame, query_id: str, tenant: Column, clearance: Column, budget: int = 1800, most: int = 10, suspicion: Column | None = None) -> DataFrame:
    """Candidates evaluated, tiered, ordered, freed of split payloads, redacted and cut to the budget.

    Candidates carry content, expected_sha256, tenant_id, acl_tier, document_id, version, source_tier, source_score, scan_status, anomaly_score,
    relevance_score, chunk_uid and parent_id.
    """
    plain = tx.for_scan(F.col("content"))
    high = {i: r for i, (s, r) in FEED.items() if s >= 0.8}
    found = scan.hits(F.concat_ws("\n", F.col("content"), plain), {i: (0.9, r) for i, r in (high | BUILT_IN).items()})
    c = candidates.withColumn("__safe", trust.safe(F.col("scan_status"), found, F.col("anomaly_score")))
    c = c.withColumn("trust_tier", trust.tier(filters.authorized(F.col("tenant_id"), F.col("acl_tier"), tenant, clearance), trust.intact(F.col("content"), F.col("expected_sha256")), trust.provenance(F.col("source_score"), F.col("document_id"), F.col("version")), F.col("__safe.safe"), F.col("source_tier"))).drop("__safe")
    o = trust.ordered(c, [query_id], "trust_tier", "relevance_score", "chunk_uid", (suspicion > 0.5) if suspicion is not None else None)
    o = search.dedupe_first(o, [query_id], "place", ["parent_id", "chunk_uid", "content"])
    kept = trust.split_payloads(o, query_id, "place", "content", high | BUILT_IN).where("kept").drop("kept")
    o = o.join(kept, [query_id, "place"])
    o = search.budget_prefix(o, [query_id], [F.col("place")], F.size(tx.tokens(F.col("content"))), budget, most)
    o = o.withColumn("redaction", masking.redacted(F.col("content")))
    return search.labelled(o, [query_id], [F.col("place")], "content")


def verified(claims: DataFrame, passages: DataFrame, group: str, claim: str, claim_text: str, source: str, passage: str, entail: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group, claim, status, confidence): claims against the passages of their question.

    Numbers and near-verbatim wording decide first; only undecided claims reach ``entail``, which adds ``entailment`` and ``contradiction`` to (claim, window) rows.
    """
    marked = passages.select(group, source, verify.sentences_marked(F.col(passage)).alias("__s"))
    w = marked.select(group, source, F.explode(verify.windows(F.col("__s"))).alias("window"))
    best = verify.best_windows(claims, w, group, claim, claim_text, source, "window")
    whole = passages.groupBy(group).agg(F.concat_ws("\n", F.array_sort(F.collect_list(passage))).alias("__all"))  # one question's passages
    good = claims.join(whole, group, "left").select(group, claim, (F.size(verify.unsupported_numbers(F.col(claim_text), F.col("__all"))) == 0).alias("numbers_ok"))
    quoted = best.groupBy(group, claim).agg(F.bool_or(verify.extractive(F.col(claim_text), F.col("window"))).alias("extract"))
    d = claims.join(good, [group, claim]).join(quoted, [group, claim], "left")
    scores = None
    if entail is not None:
        open_ = d.where(F.col("numbers_ok") & ~F.coalesce("extract", F.lit(False))).select(group, claim)
        asked = entail(best.join(open_, [group, claim], "left_semi")).withColumn("topical", tx.overlap(tx.terms(F.col(claim_text)), tx.terms(F.col("window"))))
        scores = asked.groupBy(group, claim).agg(F.max("entailment").alias("__e"), F.max(F.when(F.col("topical") >= 0.4, F.col("contradiction"))).alias("__c"), F.max("topical").alias("__t"))
    d = d.join(scores, [group, claim], "left") if scores is not None else d.withColumns({x: F.lit(None).cast("double") for x in ("__e", "__c", "__t")})
    out = verify.decision(F.col("numbers_ok"), F.lit(False), F.col("extract"), F.col("__e"), F.col("__c"), F.col("__t"))
    return d.withColumn("__o", out).select(group, claim, "__o.status", "__o.confidence")


def query_risk(embedding: Column, weights: list[float], bias: float, flag: float, block: float, alone: float) -> Column:
    """Risk of a linear classifier over an embedding, without corroboration."""
    p = vx.logistic(vx.dot(embedding, F.array(*[F.lit(float(x)) for x in weights])) + F.lit(float(bias)))
    return vx.classifier_risk(p, F.lit(flag), F.lit(block), F.lit(alone), F.lit(False))


def nearest_attack(messages: DataFrame, attacks: DataFrame, message_id: str, attack_id: str, floor: float, ceiling: float) -> DataFrame:
    """(message_id, score): highest cosine to any attack phrase, rescaled to [0, 0.60]."""
    top = search.nearest(messages, attacks, 1, message_id, attack_id)
    return top.select(message_id, F.round(vx.rescaled(F.col("score"), floor, ceiling, 0.60), 4).alias("score"))
