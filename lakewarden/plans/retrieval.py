"""Queries of retrieval, trust and the store over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import masking
from lakewarden.functions import text as tx
from lakewarden.functions import vectors as vx
from lakewarden.operators import evaluation, filters, reports, scan, search, store, trust, verify
from lakewarden.plans import pipelines
from lakewarden.plans.feed import FEED
from lakewarden.plans.registry import query
from lakewarden.runtime import cut, spread, table


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates once each, with their metadata as columns."""
    return table(spark, d, "candidates").drop("received_at").dropDuplicates(["candidate_id"]).select("candidate_id", "trace_id", "content", "relevance_score", "is_authorized", "is_intact", "has_provenance", "is_safe", "trust_tier", "uploaded_by", "evaluated_at", "metadata.*")


CANDIDATES = "(SELECT DISTINCT ON (candidate_id) candidate_id, trace_id, content, relevance_score, is_authorized, is_intact, has_provenance, is_safe, trust_tier, uploaded_by, evaluated_at, UNNEST(metadata) FROM candidates)"
_WORDS_SQL = "list_filter(string_split_regex(lower({}), '\\s+'), lambda t: t <> '')"


def source_tier(source: Column) -> Column:
    return F.when(source.isin("it_policy_portal", "legal_register", "hr_handbook"), "official").when(source.isin("partner_faq", "support_macros"), "unknown").otherwise("verified_internal")


@query()
def evidence_for_question(spark: SparkSession, d: str) -> DataFrame:
    """For a question asked in the tenant with the most documents, the passages that may be shown: keyword search over all that the tenant may see, then the
    whole evidence pipeline. The hash on record is that of a text as long as the table says; documents have no access tier, so strict authorization
    needs the full clearance."""
    docs = table(spark, d, "documents")
    # one value: the asker's tenant
    tenant = (docs.where("tenant_id <> ''").groupBy("tenant_id").count().orderBy(F.desc("count"), "tenant_id").select("tenant_id").first() or [""])[0]
    seen = spread(docs.where((F.col("tenant_id") == tenant) & F.col("text").isNotNull()))
    asked = spark.createDataFrame([(1, "how many days may data stewards keep audit logs when a restore test fails")], "question_id long, question string")
    top = search.bm25(asked, seen.select("doc_id", "text"), 16, "question_id", "question", "doc_id", "text")
    rows = top.join(seen.select("doc_id", "text", "source", "n_chars", "tenant_id"), "doc_id").withColumn("source_tier", source_tier(F.col("source")))
    found = scan.instruction_score(scan.hits(tx.for_scan(F.col("text")), FEED))
    rows = rows.select("question_id", "doc_id", "tenant_id", "source_tier", F.col("text").alias("content"), F.when(F.length("text") == F.col("n_chars"), F.sha2("text", 256)).alias("expected_sha256"), F.lit(None).cast("int").alias("acl_tier"), F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("version"), trust.source_score(F.col("source_tier")).alias("source_score"), scan.status(found, F.lit(0.0)).alias("scan_status"), F.round(found, 3).alias("anomaly_score"), F.col("score").alias("relevance_score"), F.col("doc_id").cast("string").alias("chunk_uid"), F.lit(None).cast("string").alias("parent_id"))
    shown = pipelines.evidence(rows, "question_id", F.lit(tenant), F.lit(3))
    return shown.select("question_id", "label", "doc_id", F.col("trust_tier").alias("tier"), F.round("relevance_score", 6).alias("score"), "running", F.col("redaction.text").alias("shown"))


@query()
def ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents as chunks, scanned and with their version; equal texts come in once, under the smallest id."""
    docs = spread(table(spark, d, "documents").where("text is not null"))
    files = docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min_by(F.struct("doc_id", "tenant_id", "source", "ingested_at", "text"), "doc_id").alias("f"))
    files = files.select("content_hash", "f.tenant_id", F.col("f.doc_id").cast("string").alias("document_id"), source_tier(F.col("f.source")).alias("source_tier"), "f.ingested_at", F.col("f.text").alias("content"))
    parts = pipelines.ingest(files, table(spark, d, "doc_registry"))
    return parts.select("document_id", "tenant_id", "chunk_id", "chunk_uid", "version", "source_tier", "scan_status", "anomaly_score")


@query()
def screened_messages(spark: SparkSession, d: str) -> DataFrame:
    """All questions through the screening pipeline, in the order of their session."""
    t = table(spark, d, "threat_results").select("trace_id", "session_key", "original_query", (F.unix_micros("evaluated_at") / F.lit(1e6)).alias("ts")).dropDuplicates(["trace_id"])
    m = pipelines.screen(spread(t), "session_key", "ts", "trace_id", "original_query")
    return m.select("trace_id", "session_key", "refused", F.round("base_risk", 6).alias("base_risk"), F.round("suspicion_before", 6).alias("suspicion_before"), "action")


def shown_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence pipeline over all candidates, each question in its own tenant; the greatest hash of a registered chunk stands for the record."""
    asked = table(spark, d, "layer2_results").groupBy("trace_id").agg(F.any_value("tenant_id").alias("asked"))
    c = spread(candidates(spark, d)).withColumn("key", trust.content_key(F.col("chunk_uid")))
    known = c.join(table(spark, d, "doc_registry").select(F.col("content_hash").alias("key")), "key").groupBy("key", "chunk_id").agg(F.max(F.sha2("content", 256)).alias("expected_sha256"))
    c = c.drop("trust_tier").join(known, ["key", "chunk_id"], "left").join(asked, "trace_id", "left").withColumn("parent_id", F.lit(None).cast("string"))
    return pipelines.evidence(c, "trace_id", F.col("asked"), F.lit(2))


@query()
def evidence_of_traces(spark: SparkSession, d: str) -> DataFrame:
    """For every question, the candidates that may be shown, with their tier and redacted text."""
    return shown_evidence(spark, d).select("trace_id", "label", "candidate_id", "trust_tier", "running", F.col("redaction.text").alias("shown"))


@query()
def verified_claims(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every answer against the evidence its question may be shown."""
    a = table(spark, d, "query_responses").where("answer is not null").dropDuplicates(["response_id"])
    claims = a.select("trace_id", F.posexplode(verify.sentences_marked(verify.without_citations(F.col("answer")))).alias("n", "s"), "response_id").select("trace_id", F.concat_ws("-", "response_id", "n").alias("claim"), F.col("s.text").alias("claim_text"))
    return pipelines.verified(claims, cut(shown_evidence(spark, d).select("trace_id", "candidate_id", "content")), "trace_id", "claim", "claim_text", "candidate_id", "content")


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id, list_dot_product(qv, embedding::DOUBLE[]) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid AS query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding"))
    return search.nearest(q, e, 10, "query_id", "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_BM25 = """q AS (SELECT item_id, list_filter(string_split_regex(lower(passage), '\\s+'), lambda t: t <> '') AS ts FROM heldout_passages WHERE item_id % 50 = 0),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(ts) AS term FROM q) GROUP BY ALL),
dl AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '') AS ts FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS al FROM dl),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM dl) GROUP BY ALL),
r AS (SELECT term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw, al FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
i AS (SELECT term, al, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
s AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * len / al))) AS score FROM qt JOIN i USING (term) JOIN p USING (term) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


@query("WITH " + _BM25.format(b="0.75", name="k") + " SELECT item_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "heldout_passages").where("item_id % 50 = 0")
    return search.bm25(q, spread(table(spark, d, "documents").select("doc_id", "text")), 10, "item_id", "passage", "doc_id", "text").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_EMB = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, ql, vec_id, label, list_dot_product(qv, embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> qid)"""


@query("WITH " + _EMB + """, a AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s),
b AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS rank FROM s WHERE label = ql),
u AS (SELECT *, 0 AS l FROM a WHERE rank <= 20 UNION ALL SELECT *, 1 AS l FROM b WHERE rank <= 20),
f AS (SELECT qid, vec_id, sum(1::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, vec_id::VARCHAR) AS rank FROM f)
SELECT qid AS query_id, vec_id::VARCHAR AS content, round(score, 6) AS score, rank::INTEGER AS rank FROM o WHERE rank <= 10""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of a similarity list and a list of equally labelled items."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))
    dense = search.nearest(q, e, 20, "query_id", "vec_id", with_self=False).select("query_id", F.col("vec_id").cast("string").alias("content"), "rank")
    from pyspark.sql import Window

    same = q.select("query_id", "ql").join(e.select("vec_id", "label"), F.expr("ql = label and vec_id <> query_id")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id"))).where("rank <= 20")
    return search.fused(dense, same.select("query_id", F.col("vec_id").cast("string").alias("content"), "rank"), "query_id", "content", 10)


@query("WITH " + _EMB + """, a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s),
h AS (SELECT q.qid, min(a.rank) AS hit FROM q LEFT JOIN a ON a.qid = q.qid AND a.rank <= 10 AND a.label = q.ql GROUP BY q.qid)
SELECT count(*) AS queries, round(avg(CASE WHEN hit <= 1 THEN 1 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN hit <= 5 THEN 1 ELSE 0 END), 6) AS recall_at_5,
 round(avg(CASE WHEN hit <= 10 THEN 1::DOUBLE / hit ELSE 0 END), 6) AS mrr, count(*) FILTER (hit IS NULL OR hit > 5) AS misses_at_5 FROM h""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))
    ranked = search.nearest(q, e, 10, "query_id", "vec_id", with_self=False)
    relevant = q.select("query_id", "ql").join(e.select("vec_id", "label"), F.expr("ql = label and vec_id <> query_id")).select("query_id", "vec_id")
    return search.ranking_metrics(ranked, relevant, "query_id", "vec_id")


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY trace_id, CASE WHEN chunk_uid <> '' THEN 'chunk_uid:' || chunk_uid WHEN content <> '' THEN 'content:' || content END ORDER BY candidate_id) AS n FROM {CANDIDATES})
SELECT trace_id, candidate_id FROM c WHERE n = 1""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return search.dedupe_first(candidates(spark, d), ["trace_id"], "candidate_id", ["chunk_uid", "content"]).select("trace_id", "candidate_id")


@query("""WITH t AS (SELECT source, doc_id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')) AS n FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM t)
SELECT source, doc_id, position::INTEGER AS position, running::BIGINT AS running FROM w WHERE position <= 10 AND (position = 1 OR running <= 1800)""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))
    return search.budget_prefix(docs, ["source"], [F.col("doc_id")], F.col("n"), 1800, 10).select("source", "doc_id", "position", "running")


@query(f"""WITH c AS (SELECT *, sum(length(content)) OVER (PARTITION BY trace_id ORDER BY candidate_id) AS run FROM {CANDIDATES} WHERE trim(coalesce(content, '')) <> '')
SELECT trace_id, candidate_id, 'E' || row_number() OVER (PARTITION BY trace_id ORDER BY candidate_id) AS label FROM c WHERE run <= 1500""")
def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    return search.labelled(candidates(spark, d), ["trace_id"], [F.col("candidate_id")], "content", 1500).select("trace_id", "candidate_id", "label")


@query(f"""WITH c AS (SELECT trace_id, candidate_id, row_number() OVER (PARTITION BY trace_id ORDER BY source_score DESC NULLS LAST, candidate_id) AS b, row_number() OVER (PARTITION BY trace_id ORDER BY relevance_score DESC NULLS LAST, candidate_id) AS a FROM {CANDIDATES})
SELECT count(*) AS questions, round(avg(CASE WHEN b <> 1 THEN 1 ELSE 0 END), 6) AS moved_share, quantile_disc(b, 0.5)::INTEGER AS median_from FROM c WHERE a = 1""")
def rerank_movement(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("trace_id")
    c = candidates(spark, d).withColumn("b", -F.row_number().over(w.orderBy(F.desc_nulls_last("source_score"), "candidate_id"))).withColumn("a", -F.row_number().over(w.orderBy(F.desc_nulls_last("relevance_score"), "candidate_id")))
    m = search.moved(c, ["trace_id"], "b", "a")
    return m.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("top_moved").cast("int")), 6).alias("moved_share"), reports.nearest_rank("from_rank", 0.5).alias("median_from"))


@query(f"""WITH c AS (SELECT *, CASE WHEN NOT coalesce(is_authorized, false) OR NOT coalesce(is_intact, false) THEN 'REJECT' WHEN NOT coalesce(is_safe, false) THEN 'QUARANTINE' WHEN coalesce(source_tier, 'unknown') = 'untrusted' THEN 'TIER_3'
 WHEN source_score IS NULL OR document_id IS NULL OR version IS NULL OR source_score < 0.6 OR coalesce(source_tier, 'unknown') = 'unknown' THEN 'TIER_2' ELSE 'TIER_1' END AS tier FROM {CANDIDATES}),
k AS (SELECT *, bool_or(tier IN ('TIER_1', 'TIER_2')) OVER (PARTITION BY trace_id) AS t12 FROM c WHERE tier LIKE 'TIER%')
SELECT trace_id, candidate_id, tier, (row_number() OVER (PARTITION BY trace_id ORDER BY tier, relevance_score DESC NULLS LAST, candidate_id))::INTEGER AS place FROM k WHERE tier <> 'TIER_3' OR NOT t12""")
def tier_and_order(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    proven = trust.provenance(F.col("source_score"), F.col("document_id"), F.col("version"))
    c = c.withColumn("tier", trust.tier(F.col("is_authorized"), F.col("is_intact"), proven, F.col("is_safe"), F.col("source_tier")))
    return trust.ordered(c, ["trace_id"], "tier", "relevance_score", "candidate_id").select("trace_id", "candidate_id", "tier", "place")


@query(f"""SELECT candidate_id, coalesce(tenant_id <> '' AND tenant_id = t.tenant AND coalesce(acl_tier, 3) <= 2, false) AS allowed FROM {CANDIDATES} c LEFT JOIN (SELECT trace_id AS tr, any_value(tenant_id) AS tenant FROM layer2_results GROUP BY 1) t ON c.trace_id = t.tr""")
def strict_authorization(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "layer2_results").groupBy("trace_id").agg(F.any_value("tenant_id").alias("asked"))
    return candidates(spark, d).join(asked, "trace_id", "left").select("candidate_id", filters.authorized(F.col("tenant_id"), F.col("acl_tier"), F.col("asked"), 2).alias("allowed"))


@query(f"""SELECT candidate_id, r.content_hash IS NOT NULL AS registered, r.uploaded_by AS registry_uploaded_by, r.version AS registry_version, coalesce(r.version = c.version, false) AS version_agrees
 FROM {CANDIDATES} c LEFT JOIN doc_registry r ON regexp_replace(c.chunk_uid, '_[0-9]+$', '') = r.content_hash""")
def chunk_registry_join(spark: SparkSession, d: str) -> DataFrame:
    j = trust.with_registry(candidates(spark, d), table(spark, d, "doc_registry"))
    return j.select("candidate_id", F.col("registry_content_hash").isNotNull().alias("registered"), "registry_uploaded_by", "registry_version", F.coalesce(F.col("registry_version") == F.col("version"), F.lit(False)).alias("version_agrees"))


@query(f"""WITH h AS (SELECT content_hash, chunk_id, max(sha256(content)) AS expected FROM {CANDIDATES} c JOIN doc_registry r ON regexp_replace(c.chunk_uid, '_[0-9]+$', '') = r.content_hash GROUP BY ALL)
SELECT candidate_id, coalesce(sha256(content) = expected, false) AS intact FROM {CANDIDATES} c LEFT JOIN h ON regexp_replace(c.chunk_uid, '_[0-9]+$', '') = h.content_hash AND c.chunk_id = h.chunk_id""")
def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against a hash on record (the greatest one of each registered chunk stands for the record)."""
    c = candidates(spark, d).withColumn("key", trust.content_key(F.col("chunk_uid")))
    known = c.join(table(spark, d, "doc_registry").select(F.col("content_hash").alias("key")), "key").groupBy("key", "chunk_id").agg(F.max(F.sha2("content", 256)).alias("expected"))
    return c.join(known, ["key", "chunk_id"], "left").select("candidate_id", trust.intact(F.col("content"), F.col("expected")).alias("intact"))


_FEED_SQL = ", ".join(f"CASE WHEN regexp_matches(t, '(?ism){r.replace(chr(39), chr(39) * 2)}') THEN '{i}' END" for i, (s, r) in FEED.items())


@query(f"SELECT doc_id, list_aggregate(list_filter([{_FEED_SQL}], lambda x: x IS NOT NULL), 'string_agg', ',') AS hits FROM (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL) WHERE len(list_filter([{_FEED_SQL}], lambda x: x IS NOT NULL)) > 0")
def pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents with patterns of the feed."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null"))
    # behind a generator, the costly expression is evaluated once, and not pushed below the shuffle that spreads it
    found = F.explode(F.array(F.array_join(scan.hits(F.col("text"), FEED)["id"], ",")))
    return rows.select("doc_id", found.alias("hits")).where("hits <> ''")


@query(f"""WITH c AS (SELECT candidate_id, coalesce(scan_status, 'clean') AS s, coalesce(anomaly_score, 0) AS a FROM {CANDIDATES}),
r AS (SELECT *, CASE WHEN s = 'quarantined' THEN 1.0::DOUBLE WHEN a >= 0.3 THEN a ELSE 0::DOUBLE END AS risk FROM c) SELECT candidate_id, risk = 0 AS safe, risk FROM r""")
def safety_rule(spark: SparkSession, d: str) -> DataFrame:
    s = trust.safe(F.col("scan_status"), F.array().cast("array<string>"), F.col("anomaly_score"))
    return candidates(spark, d).withColumn("s", s).select("candidate_id", "s.safe", "s.risk")


@query("""WITH e AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS v FROM embeddings),
c AS (SELECT label, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(v[d]) AS x FROM e, range(1, 65) t(d) GROUP BY ALL) GROUP BY label),
f AS (SELECT label, vec_id, 1 - list_dot_product(v, c) / (sqrt(list_dot_product(c, c)) + 1e-12) AS dist FROM e JOIN c USING (label)),
m AS (SELECT label, median(dist) AS m, count(*) AS n FROM f GROUP BY label),
d AS (SELECT label, median(abs(dist - m)) AS mad, any_value(m) AS m, any_value(n) AS n FROM f JOIN m USING (label) GROUP BY label)
SELECT label, vec_id, round(dist, 6) AS distance, round(CASE WHEN n < 5 OR mad < 1e-9 THEN 0 ELSE (dist - m) / (1.4826 * mad) END, 4) AS z,
 round(0.6 * least(greatest((CASE WHEN n < 5 OR mad < 1e-9 THEN 0 ELSE (dist - m) / (1.4826 * mad) END - 2) / 4, 0), 1), 4) AS score FROM f JOIN d USING (label)""")
def embedding_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = scan.outliers(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return o.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.round("z", 4).alias("z"), F.round("score", 4).alias("score"))


@query(f"""WITH c AS (SELECT candidate_id, document_id, scan_status, max(CASE WHEN scan_status = 'quarantined' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id) AS bad FROM {CANDIDATES})
SELECT candidate_id, CASE WHEN document_id <> '' AND bad = 1 THEN 'quarantined' ELSE scan_status END AS scan_status FROM c""")
def quarantine_propagation(spark: SparkSession, d: str) -> DataFrame:
    return scan.propagated(candidates(spark, d), "document_id").select("candidate_id", "scan_status")


@query(f"""SELECT candidate_id FROM {CANDIDATES} WHERE coalesce(tenant_id, 'default_tenant') LIKE 'tnt-%' AND coalesce(acl_tier, 1) <= 2 AND (source_tier IN ('official', 'verified_internal') OR source_score > 0.75) AND scan_status IS DISTINCT FROM 'quarantined'""")
def filter_language(spark: SparkSession, d: str) -> DataFrame:
    condition = {"acl_tier": {"$lte": 2}, "$or": [{"source_tier": {"$in": ["official", "verified_internal"]}}, {"source_score": {"$gt": 0.75}}], "scan_status": {"$ne": "quarantined"}}
    return candidates(spark, d).where(F.coalesce("tenant_id", F.lit("default_tenant")).startswith("tnt-") & filters.compile_filter(condition)).select("candidate_id")


@query("""SELECT tenant_id, document_id, (max(version) + 1)::INTEGER AS next_version FROM doc_registry GROUP BY ALL""")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "doc_registry")
    new = r.select("tenant_id", "document_id").distinct().withColumn("ingested_at", F.lit(1))
    return store.next_versions(new, r).select("tenant_id", "document_id", F.col("version").alias("next_version"))


@query(f"""WITH r AS (SELECT content_hash AS id FROM doc_registry), k AS (SELECT regexp_replace(chunk_uid, '_[0-9]+$', '') AS id FROM {CANDIDATES} GROUP BY 1), v AS (SELECT document_id AS id FROM doc_registry),
c AS (SELECT id, sum(r) AS r, sum(k) AS k, sum(v) AS v FROM (SELECT id, 1 AS r, 0 AS k, 0 AS v FROM r UNION ALL SELECT id, 0, 1, 0 FROM k UNION ALL SELECT id, 0, 0, 1 FROM v) GROUP BY id)
SELECT count(*) FILTER (id IS NOT NULL AND r > 0 AND k = 0) AS missing_in_keyword, count(*) FILTER (id IS NOT NULL AND r > 0 AND v = 0) AS missing_in_vector, count(*) FILTER (id IS NOT NULL AND r = 0 AND k > 0) AS unknown_in_keyword,
 count(*) FILTER (id IS NOT NULL AND r = 0 AND v > 0) AS unknown_in_vector, coalesce(sum(r + k + v) FILTER (id IS NULL), 0)::BIGINT AS null_ids,
 coalesce(sum(greatest(r - 1, 0) + greatest(k - 1, 0) + greatest(v - 1, 0)) FILTER (id IS NOT NULL), 0)::BIGINT AS duplicate_ids FROM c""")
def store_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Counters over three stores, here registry hashes, candidates' hashes and document names, which differ on purpose."""
    r = table(spark, d, "doc_registry")
    k = candidates(spark, d).select(trust.content_key(F.col("chunk_uid")).alias("id")).distinct()
    return store.consistency(r.select(F.col("content_hash").alias("id")), k, r.select(F.col("document_id").alias("id")), "id")


@query(f"""SELECT regexp_replace(chunk_uid, '_[0-9]+$', '') AS content_hash, count(*) AS total_chunks, count(*) FILTER (scan_status IS NULL OR scan_status <> 'quarantined') - count(*) FILTER (scan_status IS NULL) AS chunk_count, count(*) FILTER (scan_status = 'flagged') AS flagged_count,
 count(DISTINCT struct_pack(a := chunk_id, b := chunk_uid, c := sha256(content)))::INTEGER AS distinct_chunks FROM {CANDIDATES} GROUP BY 1""")
def registry_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).withColumn("content_hash", trust.content_key(F.col("chunk_uid")))
    c = c.withColumn("chunk_uid", F.concat_ws("#", "chunk_uid", F.sha2("content", 256)))  # one entry a content of a chunk
    return store.registry_rollup(c).select("content_hash", "total_chunks", "chunk_count", "flagged_count", F.size("ids").alias("distinct_chunks"))


@query("""SELECT content_hash, coalesce(CASE WHEN tenant_id <> '' THEN tenant_id END, 'default_tenant') AS tenant_id, coalesce(acl_tier, 1) AS acl_tier FROM doc_registry""")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    return store.backfilled(table(spark, d, "doc_registry")).select("content_hash", "tenant_id", "acl_tier")


@query("""SELECT content_hash, CASE WHEN document_id IN (SELECT document_id FROM doc_registry WHERE version >= 3) THEN 3 ELSE acl_tier END AS acl_tier FROM doc_registry""")
def reclassify(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "doc_registry")
    changes = r.where("version >= 3 and document_id is not null").select("document_id").distinct().withColumn("acl_tier", F.lit(3))
    return store.reclassified(r, changes, "document_id").select("content_hash", "acl_tier")


@query("""SELECT content_hash FROM doc_registry r WHERE NOT EXISTS (SELECT 1 FROM doc_registry g WHERE g.version = 1 AND g.tenant_id = r.tenant_id AND g.document_id = r.document_id)""")
def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "doc_registry")
    return store.deleted(r, r.where("version = 1").select("tenant_id", "document_id"), ["tenant_id", "document_id"]).select("content_hash")


@query(f"""SELECT DISTINCT h FROM (SELECT sha256(content) AS h FROM {CANDIDATES} WHERE content IS NOT NULL) WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    want = candidates(spark, d).where("content is not null").select(F.sha2("content", 256).alias("h"))
    return store.missing(want, table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("h")), "h")


_REDACT = {k: p.replace("(?!000|666|9\\d{2})", "").replace("(?!00)", "").replace("(?!0000)", "") for k, (p, _) in masking.REDACTED.items()}


@query(f"""WITH c AS (SELECT candidate_id, content AS t FROM {CANDIDATES} WHERE content IS NOT NULL),
s AS (SELECT candidate_id, len(list_filter(regexp_extract_all(t, '{_REDACT["SSN"]}'), lambda x: NOT (regexp_replace(x, '[- ]', '', 'g')[1:3] IN ('000', '666') OR x[1:1] = '9' OR regexp_replace(x, '[- ]', '', 'g')[4:5] = '00' OR regexp_replace(x, '[- ]', '', 'g')[6:9] = '0000'))) AS ssn,
 len(regexp_extract_all(t, '{_REDACT["EMAIL"]}')) AS email FROM c) SELECT candidate_id, ssn::INTEGER AS ssn, email::INTEGER AS email FROM s WHERE ssn + email > 0""")
def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    r = candidates(spark, d).where("content is not null").select("candidate_id", masking.redacted(F.col("content"))["masked"].alias("m"))
    r = r.select("candidate_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(k.lower()) for k in ("SSN", "EMAIL")])
    return r.where("ssn + email > 0")


@query(f"""WITH c AS (SELECT candidate_id, list_filter(string_split_regex(lower(coalesce(content, '')), '\\s+'), lambda t: t <> '') AS w FROM {CANDIDATES}),
x AS (SELECT candidate_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 40 THEN [0] ELSE range(0, (ceil((len(w) - 40) / 20.0) * 20)::BIGINT + 1, 20) END) AS i FROM c)
SELECT candidate_id, (i // 20)::INTEGER AS window_no, md5(array_to_string(w[i + 1 : i + 40], ' ')) AS words FROM x""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    w = candidates(spark, d).select("candidate_id", F.posexplode(verify.word_windows(F.col("content"))).alias("window_no", "w"))
    return w.select("candidate_id", "window_no", F.md5("w").alias("words"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_TERMS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: NOT list_contains(" + _STOP_SQL + ", w)))"
_NUM_SQL = "list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '\\d[\\d,]*\\.?\\d*'), lambda n: regexp_replace(replace(n, ',', ''), '\\.$', '')))"
_NEG_SQL = "len(regexp_extract_all(coalesce({0}, ''), '(?i)\\b(?:not|no|never|cannot|without|neither|nor)\\b|n''t'))"


@query(f"""WITH a AS (SELECT DISTINCT ON (response_id) response_id, trace_id, answer FROM query_responses WHERE answer IS NOT NULL),
j AS (SELECT response_id, candidate_id, {_TERMS_SQL.format("answer")} AS aw, {_TERMS_SQL.format("content")} AS ct, {_NUM_SQL.format("answer")} AS an, {_NUM_SQL.format("content")} AS cn, {_NEG_SQL.format("answer")} AS ag, {_NEG_SQL.format("content")} AS cg FROM a JOIN {CANDIDATES} c USING (trace_id))
SELECT response_id, candidate_id, round(CASE WHEN len(aw) = 0 THEN 0 ELSE len(list_intersect(aw, ct)) / len(aw) END, 6) AS coverage, len(list_filter(an, lambda n: NOT list_contains(cn, n)))::INTEGER AS new_numbers,
 len(aw) >= 2 AND len(list_intersect(aw, ct)) / len(aw) >= 0.9 AND len(list_filter(an, lambda n: NOT list_contains(cn, n))) = 0 AND ag = cg AS extractive FROM j""")
def extractive_match(spark: SparkSession, d: str) -> DataFrame:
    """Answers against the passages of their own trace."""
    a = table(spark, d, "query_responses").where("answer is not null").dropDuplicates(["response_id"]).select("response_id", "trace_id", "answer")
    j = a.join(candidates(spark, d).select("candidate_id", "trace_id", "content"), "trace_id")
    return j.select("response_id", "candidate_id", F.round(tx.overlap(tx.terms(F.col("answer")), tx.terms(F.col("content"))), 6).alias("coverage"), F.size(F.array_except(tx.numbers(F.col("answer")), tx.numbers(F.col("content")))).alias("new_numbers"), verify.extractive(F.col("answer"), F.col("content")).alias("extractive"))


@query()
def contradicting_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of unverified passages that contradict a trusted passage of the same document."""
    c = candidates(spark, d).where("content is not null and document_id is not null")
    return trust.contradictions(c.where("trust_tier <> 'TIER_1'"), c.where("trust_tier = 'TIER_1'"), "document_id", "candidate_id", "content")


@query()
def split_payload_fold(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return trust.split_payloads(c, "trace_id", "candidate_id", "content", {k: r for k, (_, r) in FEED.items()})


@query()
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of answers that no passage of their trace states or spans."""
    a = table(spark, d, "query_responses").where("answer is not null").dropDuplicates(["response_id"]).select("response_id", "trace_id", verify.without_citations(F.col("answer")).alias("answer"))
    e = candidates(spark, d).groupBy("trace_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list("content"))).alias("evidence"))
    return a.join(e, "trace_id").select("response_id", F.array_sort(verify.unsupported_numbers(F.col("answer"), F.col("evidence"))).alias("numbers")).where(F.size("numbers") > 0)


@query()
def best_claim_windows(spark: SparkSession, d: str) -> DataFrame:
    """The evidence windows that fit each sentence of an answer best."""
    a = table(spark, d, "query_responses").where("answer is not null").dropDuplicates(["response_id"])
    claims = a.select("trace_id", F.posexplode(verify.sentences_marked(verify.without_citations(F.col("answer")))).alias("n", "s")).select("trace_id", F.concat_ws("-", "trace_id", "n").alias("claim"), F.col("s.text").alias("claim_text"))
    marked = candidates(spark, d).where("content is not null").select("trace_id", "candidate_id", verify.sentences_marked(F.col("content")).alias("s"))
    e = marked.select("trace_id", "candidate_id", F.explode(verify.windows(F.col("s"))).alias("window"))
    return verify.best_windows(claims, e, "trace_id", "claim", "claim_text", "candidate_id", "window").select("claim", "candidate_id", "window", F.round("score", 6).alias("score"), "rank")


@query()
def table_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The rows with the unique highest and lowest value of each numeric column of the tables in candidates."""
    c = candidates(spark, d).where("content like '%|%'").select("candidate_id", verify.tables(F.col("content")).alias("t"))
    return verify.extremes(verify.table_cells(c, ["candidate_id"], "t"), ["candidate_id"])


@query("""SELECT vec_id, round(p, 6) AS p, round(CASE WHEN p < 0.45 THEN 0 WHEN p < 0.55 THEN 0.30 + 0.20 * (p - 0.45) / 0.1 WHEN label = 1 OR p >= 0.6 THEN least(greatest(0.85 + 0.15 * (p - 0.55) / 0.45, 0), 1) ELSE 0.60 END, 6) AS risk
 FROM (SELECT vec_id, label, 1 / (1 + exp(-list_dot_product(embedding::DOUBLE[], list_transform(range(1, 65), lambda i: (i % 3 - 1)::DOUBLE)))) AS p FROM embeddings)""")
def classifier_risk(spark: SparkSession, d: str) -> DataFrame:
    weights = F.array(*[F.lit(float(i % 3 - 1)) for i in range(1, 65)])
    e = table(spark, d, "embeddings").withColumn("p", vx.logistic(vx.dot(F.col("embedding"), weights)))
    risk = vx.classifier_risk(F.col("p"), F.lit(0.45), F.lit(0.55), F.lit(0.6), F.col("label") == 1)
    return e.select("vec_id", F.round("p", 6).alias("p"), F.round(risk, 6).alias("risk"))


@query("""SELECT id, len(list_filter(facts, lambda f: len(list_filter(f, lambda x: contains(lower(coalesce(reference, '')), lower(x)))) > 0))::INTEGER AS found, len(facts)::INTEGER AS wanted FROM (SELECT DISTINCT ON (id) id, facts, reference FROM qa WHERE facts IS NOT NULL)""")
def facts_found(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa").where("facts is not null").dropDuplicates(["id"])
    return q.withColumn("f", evaluation.facts_found(F.col("reference"), F.col("facts"))).select("id", "f.found", "f.wanted")
