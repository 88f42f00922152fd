"""Queries of screening logs, stateful logic, reports, statistics and dataset building over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import text as tx
from lakewarden.functions import vectors as vx
from lakewarden.functions.decoding import decoded, encoded
from lakewarden.operators import audit, chunking, datasets, evaluation, filters, ranks, reports, state
from lakewarden.plans.registry import query
from lakewarden.plans.retrieval import CANDIDATES, candidates
from lakewarden.runtime import spread, table


def screened(spark: SparkSession, d: str) -> DataFrame:
    """Screening results once each, with the second they were evaluated at."""
    t = table(spark, d, "threat_results").drop("received_at", "detector_scores", "reasons").dropDuplicates(["trace_id"])
    return t.withColumn("ts", F.unix_micros("evaluated_at") / F.lit(1e6))


SCREENED = "(SELECT DISTINCT ON (trace_id) *, epoch_us(evaluated_at) / 1e6::DOUBLE AS ts FROM threat_results)"
_OK = "execution_time_ms IS NOT NULL AND NOT isnan(execution_time_ms)"


@query(f"SELECT coalesce(action, 'unknown') AS action, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {SCREENED} GROUP BY 1")
def outcome_shares(spark: SparkSession, d: str) -> DataFrame:
    return reports.outcome_shares(screened(spark, d), "action")


@query(f"""WITH t AS (SELECT action, execution_time_ms AS v FROM {SCREENED} WHERE {_OK})
SELECT action, count(v) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, max(v) AS max FROM (SELECT * FROM t UNION ALL SELECT 'total', v FROM t) GROUP BY action""")
def latency_by_action(spark: SparkSession, d: str) -> DataFrame:
    return reports.latency(screened(spark, d).where("execution_time_ms is not null and not isnan(execution_time_ms)"), ["action"], "execution_time_ms")


@query(f"""WITH t AS (SELECT action, execution_time_ms AS v, row_number() OVER (PARTITION BY action ORDER BY execution_time_ms) AS r, count(*) OVER (PARTITION BY action) AS n FROM {SCREENED} WHERE {_OK})
SELECT action, max(n) AS n, min(v) FILTER (r >= least(floor(0.5::DOUBLE * n), n - 1) + 1) AS floor_p50, min(v) FILTER (r >= least(floor(0.95::DOUBLE * n), n - 1) + 1) AS floor_p95,
 min(v) FILTER (r >= floor(0.5::DOUBLE * (n - 1) + 0.5::DOUBLE) + 1) AS rounded_p50, min(v) FILTER (r >= floor(0.95::DOUBLE * (n - 1) + 0.5::DOUBLE) + 1) AS rounded_p95,
 round(quantile_cont(v, 0.5), 6) AS linear_p50, round(quantile_cont(v, 0.95), 6) AS linear_p95, round(stddev_pop(v), 4) AS spread FROM t GROUP BY action""")
def percentile_variants(spark: SparkSession, d: str) -> DataFrame:
    """The definitions of a percentile side by side."""
    t = screened(spark, d).where("execution_time_ms is not null and not isnan(execution_time_ms)").select("action", F.col("execution_time_ms").alias("v"))
    low = reports.floor_index(t, ["action"], "v", [0.5, 0.95]).select("action", "n", F.col("p50").alias("floor_p50"), F.col("p95").alias("floor_p95"))
    mid = reports.rounded_index(t, ["action"], "v", [0.5, 0.95]).select("action", F.col("p50").alias("rounded_p50"), F.col("p95").alias("rounded_p95"))
    line = ranks.interpolated(t, ["action"], "v", {"a": 0.5, "b": 0.95}).select("action", F.round("a", 6).alias("linear_p50"), F.round("b", 6).alias("linear_p95"))
    return low.join(mid, "action").join(line, "action").join(t.groupBy("action").agg(F.round(F.stddev_pop("v"), 4).alias("spread")), "action")


@query(f"SELECT trace_id, execution_time_ms FROM {SCREENED} WHERE {_OK} ORDER BY execution_time_ms DESC, trace_id LIMIT 10")
def slowest(spark: SparkSession, d: str) -> DataFrame:
    return reports.slowest(screened(spark, d).where("execution_time_ms is not null and not isnan(execution_time_ms)").select("trace_id", "execution_time_ms"), "execution_time_ms", "trace_id")


@query(f"""WITH t AS (SELECT len(string_split_regex(trim(original_query), '\\s+')) AS n, execution_time_ms AS v FROM {SCREENED} WHERE {_OK} AND trim(coalesce(original_query, '')) <> '')
SELECT CASE WHEN n <= 20 THEN '001-020' WHEN n <= 50 THEN '021-050' WHEN n <= 150 THEN '051-150' ELSE '151+' END AS words, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95 FROM t GROUP BY 1""")
def latency_by_length(spark: SparkSession, d: str) -> DataFrame:
    t = screened(spark, d).where("execution_time_ms is not null and not isnan(execution_time_ms)").withColumn("w", F.size(tx.tokens(F.col("original_query")))).where("w > 0")
    bucket = F.when(F.col("w") <= 20, "001-020").when(F.col("w") <= 50, "021-050").when(F.col("w") <= 150, "051-150").otherwise("151+")
    return reports.latency(t.withColumn("words", bucket), ["words"], "execution_time_ms", (0.5, 0.95)).where("words <> 'total'").drop("max")


@query(f"""WITH p AS (SELECT count(v) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM (SELECT execution_time_ms AS v FROM {SCREENED} WHERE {_OK}))
SELECT *, array_to_string(list_filter([CASE WHEN p50 > 50 THEN 'p50' END, CASE WHEN p95 > 700 THEN 'p95' END, CASE WHEN p99 > 10000 THEN 'p99' END], lambda x: x IS NOT NULL), ',') AS violations, NOT (p50 > 50 OR p95 > 700 OR p99 > 10000) AS passed FROM p""")
def latency_limits(spark: SparkSession, d: str) -> DataFrame:
    return reports.limits_broken(screened(spark, d).where("execution_time_ms is not null and not isnan(execution_time_ms)"), "execution_time_ms", {0.5: 50, 0.95: 700, 0.99: 10000})


@query("""WITH a AS (SELECT DISTINCT ON (response_id) response_id, coalesce(intent, 'unknown') AS intent, CASE WHEN admin_view THEN 'admin' ELSE 'user' END AS view FROM query_responses)
SELECT intent, count(*) FILTER (view = 'admin') AS admin, count(*) FILTER (view = 'user') AS user FROM a GROUP BY intent""")
def feedback_pivot(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "query_responses").dropDuplicates(["response_id"]).select(F.coalesce("intent", F.lit("unknown")).alias("intent"), F.when(F.col("admin_view"), "admin").otherwise("user").alias("view"))
    return reports.feedback_pivot(a, "intent", "view", ["admin", "user"])


@query(f"SELECT session_key, trace_id, action FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY ts DESC, trace_id DESC) AS n FROM {SCREENED}) WHERE n = 1")
def latest_record(spark: SparkSession, d: str) -> DataFrame:
    return reports.latest(screened(spark, d), ["session_key"], F.desc("ts"), F.desc("trace_id")).select("session_key", "trace_id", "action")


@query("""SELECT DISTINCT ON (r.response_id) r.response_id, t.action, l.status FROM query_responses r JOIN (SELECT DISTINCT trace_id, action FROM threat_results) t USING (trace_id) JOIN (SELECT DISTINCT trace_id, status FROM layer2_results) l USING (trace_id)""")
def response_trail(spark: SparkSession, d: str) -> DataFrame:
    """Answers with what each layer decided about their question."""
    r = table(spark, d, "query_responses").select("response_id", "trace_id").distinct()
    t = table(spark, d, "threat_results").select("trace_id", "action").distinct()
    return r.join(t, "trace_id").join(table(spark, d, "layer2_results").select("trace_id", "status").distinct(), "trace_id").select("response_id", "action", "status")


@query(f"""SELECT tenant_id, count(*) AS n, round(avg(CASE WHEN trust_tier = 'TIER_1' THEN 1.0 ELSE 0.0 END), 6) AS tier1, source_tier FROM
 (SELECT coalesce(tenant_id, 'unknown') AS tenant_id, coalesce(source_tier, 'unknown') AS source_tier, trust_tier FROM {CANDIDATES}) GROUP BY ROLLUP (tenant_id, source_tier)""".replace("SELECT tenant_id, count(*)", "SELECT coalesce(tenant_id, 'all') AS tenant_id, count(*)", 1).replace(" AS tier1, source_tier FROM", " AS tier1, coalesce(source_tier, 'all') AS source_tier FROM", 1))
def grouping_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of tier 1 a tenant and source tier, a tenant, and overall."""
    c = candidates(spark, d)
    return reports.grouping_report(c, ["tenant_id", "source_tier"], {"tier1": F.coalesce((F.col("trust_tier") == "TIER_1").cast("int"), F.lit(0))}, [["tenant_id", "source_tier"], ["tenant_id"], []])


@query(f"SELECT tenant_id, count(*) AS records, CAST(NULL AS DOUBLE) AS first_broken FROM {SCREENED} GROUP BY tenant_id")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Screening results sealed into a hash chain a tenant, and the chains verified."""
    s = screened(spark, d).select("tenant_id", F.concat(F.lpad(F.unix_micros("evaluated_at").cast("string"), 20, "0"), "trace_id").alias("position"), "trace_id", "action", "ts")
    sealed = audit.sealed(s, "tenant_id", "position", ["trace_id", "action"])
    return audit.broken(sealed, "tenant_id", "position", ["trace_id", "action"]).withColumn("first_broken", F.col("first_broken").cast("double"))


_EVIDENCE = "CASE WHEN action = 'BLOCK' THEN 1.0::DOUBLE WHEN base_risk < 0.2 THEN NULL ELSE least(greatest((base_risk - 0.2) / 0.6, 0), 1) END"


@query(f"""WITH e AS (SELECT session_key, list(struct_pack(t := ts, e := {_EVIDENCE}, s := 0.0::DOUBLE) ORDER BY ts, trace_id) AS l, count(*) AS n FROM {SCREENED} WHERE base_risk IS NOT NULL GROUP BY session_key),
f AS (SELECT session_key, n, list_reduce(list_prepend(struct_pack(t := l[1].t, e := 0.0::DOUBLE, s := 0.0::DOUBLE), l), lambda a, x: struct_pack(t := x.t, e := x.e, s := CASE WHEN x.e IS NULL THEN 0.95::DOUBLE * a.s * pow(2.0::DOUBLE, -greatest(x.t - a.t, 0) / 600)
  ELSE a.s * pow(2.0::DOUBLE, -greatest(x.t - a.t, 0) / 600) + (1 - a.s * pow(2.0::DOUBLE, -greatest(x.t - a.t, 0) / 600)) * 0.5::DOUBLE * x.e END)) AS r FROM e)
SELECT session_key, n, round(r.s, 6) AS suspicion FROM f""")
def suspicion_fold(spark: SparkSession, d: str) -> DataFrame:
    """The suspicion of each session after its last message."""
    s = screened(spark, d).where("base_risk is not null").withColumn("e", state.evidence_of(F.col("base_risk"), F.col("action") == "BLOCK"))
    s = state.suspicion(s.select("session_key", "ts", "trace_id", "e"), "session_key", "ts", "e", "trace_id")
    return s.groupBy("session_key").agg(F.count("*").alias("n"), F.round(F.max_by("suspicion_after", F.struct("ts", "trace_id")), 6).alias("suspicion"))


@query(f"""WITH e AS (SELECT tenant_id, list(ts ORDER BY ts, trace_id) AS l FROM {SCREENED} GROUP BY tenant_id),
f AS (SELECT tenant_id, list_reduce(list_transform(list_prepend(l[1], l), lambda t: struct_pack(t := t, k := 2.0::DOUBLE, n := 0)), lambda a, x: struct_pack(t := x.t, k := CASE WHEN least(2.0::DOUBLE, a.k + (x.t - a.t) * 0.0005::DOUBLE) >= 1 THEN least(2.0::DOUBLE, a.k + (x.t - a.t) * 0.0005::DOUBLE) - 1 ELSE least(2.0::DOUBLE, a.k + (x.t - a.t) * 0.0005::DOUBLE) END,
  n := a.n + CASE WHEN least(2.0::DOUBLE, a.k + (x.t - a.t) * 0.0005::DOUBLE) >= 1 THEN 1 ELSE 0 END)) AS r FROM e) SELECT tenant_id, r.n::BIGINT AS allowed FROM f""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Messages a tenant's bucket of two tokens, refilled every 2,000 seconds, would admit."""
    b = state.token_bucket(screened(spark, d).select("tenant_id", "ts", "trace_id"), "tenant_id", "ts", "trace_id", 2.0, 0.0005)
    return b.groupBy("tenant_id").agg(F.count_if("allowed").alias("allowed"))


@query(f"""WITH b AS (SELECT tenant_id, trace_id, floor(ts)::BIGINT AS s FROM {SCREENED} WHERE action = 'BLOCK'),
w AS (SELECT *, count(*) OVER (PARTITION BY tenant_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent FROM b) SELECT trace_id, recent, recent >= 5 AS locked FROM w""")
def lockout_windows(spark: SparkSession, d: str) -> DataFrame:
    """Blocked messages of a tenant within a day."""
    b = screened(spark, d).where("action = 'BLOCK'").withColumn("s", F.floor("ts").cast("long"))
    return state.lockouts(b, ["tenant_id"], "s", 5, 86400).select("trace_id", "recent", "locked")


@query(f"""WITH t AS (SELECT session_key, action, row_number() OVER (PARTITION BY session_key ORDER BY ts, trace_id) AS n FROM {SCREENED})
SELECT session_key, count(*) AS turns, count(*) FILTER (action <> 'BLOCK') AS released, (min(n) FILTER (action = 'BLOCK'))::INTEGER AS first_block, bool_or(n <= 20 AND action = 'PASS') AS undetected_within_budget FROM t GROUP BY session_key""")
def session_first_block(spark: SparkSession, d: str) -> DataFrame:
    s = screened(spark, d).withColumn("turn", F.struct("ts", "trace_id"))
    return state.sessions(s, "session_key", "turn", "action")


@query(f"SELECT coalesce(tenant_id, '-') AS tenant_id, count(*) AS n, count(*) FILTER (is_safe) AS k, round(count(*) FILTER (is_safe) / count(*), 6) AS rate,"
       " round(greatest((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0), 6) AS low, round(least((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 1), 6) AS high FROM x".replace(
           f"SELECT coalesce(tenant_id, '-') AS tenant_id, count(*) AS n, count(*) FILTER (is_safe) AS k, round(count(*) FILTER (is_safe) / count(*), 6) AS rate,",
           f"WITH g AS (SELECT coalesce(tenant_id, '-') AS tenant_id, count(*) AS n, count(*) FILTER (is_safe) AS k FROM {CANDIDATES} GROUP BY 1), x AS (SELECT *, k::DOUBLE / n AS p FROM g) SELECT tenant_id, n, k, round(p, 6) AS rate,"))
def wilson_rates(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).withColumn("tenant_id", F.coalesce("tenant_id", F.lit("-")))
    return evaluation.rates(c, ["tenant_id"], F.col("is_safe"))


@query(f"""WITH g AS (SELECT count(*) FILTER (coalesce(base_risk >= 0.3, false) AND action <> 'PASS') AS tp, count(*) FILTER (coalesce(base_risk >= 0.3, false) AND NOT action <> 'PASS') AS fp,
 count(*) FILTER (NOT coalesce(base_risk >= 0.3, false) AND action <> 'PASS') AS fn, count(*) FILTER (NOT coalesce(base_risk >= 0.3, false) AND NOT action <> 'PASS') AS tn FROM {SCREENED})
SELECT *, round(100 * tp / (tp + fp), 2) AS precision, round(100 * tp / (tp + fn), 2) AS recall, round(200 * tp / (2 * tp + fp + fn), 2) AS f1 FROM g""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(screened(spark, d), F.col("base_risk") >= 0.3, F.col("action") != "PASS")


@query(f"""WITH c AS (SELECT coalesce(is_intact, false) AS a, coalesce(has_provenance, false) AS b FROM {CANDIDATES}), g AS (SELECT count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second FROM c),
t AS (SELECT only_first, only_second, only_first + only_second AS n, least(only_first, only_second) AS k FROM g)
SELECT only_first, only_second, round(CASE WHEN n = 0 THEN 1 ELSE least(2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2::DOUBLE))) FROM range(0, k + 1) r(i)), 1) END, 6) AS p FROM t""")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.mcnemar(candidates(spark, d), F.col("is_intact"), F.col("has_provenance"))


@query(f"""WITH c AS (SELECT trust_tier AS a, CASE WHEN is_safe THEN 'TIER_1' ELSE 'QUARANTINE' END AS b FROM {CANDIDATES} WHERE trust_tier IS NOT NULL AND is_safe IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1 ELSE 0 END) AS po FROM c),
e AS (SELECT sum(x * y) AS pe FROM (SELECT a AS k, count(*)::DOUBLE AS x FROM c GROUP BY a) JOIN (SELECT b AS k, count(*)::DOUBLE AS y FROM c GROUP BY b) USING (k))
SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - pe / (n * n)) / (1 - pe / (n * n)), 6) AS kappa FROM n, e""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).withColumn("b", F.when(F.col("is_safe").isNotNull(), F.when(F.col("is_safe"), "TIER_1").otherwise("QUARANTINE")))
    return evaluation.kappa(c, "trust_tier", "b")


def _threshold_sql(fp: float) -> str:
    return f"(SELECT max(base_risk) FROM (SELECT base_risk, row_number() OVER (ORDER BY base_risk DESC) AS r, count(*) OVER () AS n FROM s) WHERE r = floor({fp}::DOUBLE * n + 1e-9) + 1)"


@query(f"""WITH s AS (SELECT base_risk FROM {SCREENED} WHERE action = 'PASS' AND base_risk IS NOT NULL), t AS (SELECT {_threshold_sql(0.05)} AS f, {_threshold_sql(0.01)} AS b, {_threshold_sql(0.001)} AS a)
SELECT f AS flag, greatest(f, b) AS block, greatest(f, b, a) AS block_alone FROM t""")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibrated(screened(spark, d), "base_risk", F.col("action") == "PASS", 0.05, 0.01, 0.001)


@query(f"""WITH s AS (SELECT base_risk AS r, action <> 'PASS' AS p FROM {SCREENED}), c AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7])::DOUBLE AS cutoff),
g AS (SELECT cutoff, count(*) FILTER (r >= cutoff AND p) AS tp, count(*) FILTER (r >= cutoff AND NOT p) AS fp, count(*) FILTER (p) - count(*) FILTER (r >= cutoff AND p) AS fn, count(*) FILTER (NOT p) - count(*) FILTER (r >= cutoff AND NOT p) AS tn FROM s, c GROUP BY cutoff)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM g""")
def cutoff_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.cutoff_sweep(screened(spark, d), "base_risk", F.col("action") != "PASS", [0.1, 0.2, 0.3, 0.5, 0.7])


@query(f"""WITH s AS (SELECT *, coalesce(list_max(map_values(detector_scores)), 0) AS m FROM threat_results) SELECT DISTINCT trace_id, round(m, 6) AS highest, CASE WHEN m >= 0.8 THEN 'BLOCK' WHEN m >= 0.3 THEN 'FLAG' ELSE 'PASS' END AS by_scores FROM s""")
def base_risk_action(spark: SparkSession, d: str) -> DataFrame:
    """The highest detector score and the action it would have on its own."""
    t = table(spark, d, "threat_results").select("trace_id", F.coalesce(F.array_max(F.map_values("detector_scores")), F.lit(0.0)).alias("m")).distinct()
    fixed = F.struct(F.lit(0.8).alias("block"), F.lit(0.3).alias("flag"))
    return t.select("trace_id", F.round("m", 6).alias("highest"), state.action(F.col("m"), fixed).alias("by_scores"))


@query(f"""SELECT trace_id, CASE WHEN n = 0 THEN 'empty' WHEN strlen(original_query) > 600 THEN 'too_large' WHEN n > 60 THEN 'too_long' END AS refused FROM
 (SELECT trace_id, original_query, len(list_filter(string_split_regex(coalesce(original_query, ''), '\\s+'), lambda w: w <> '')) AS n FROM {SCREENED}) WHERE n = 0 OR strlen(original_query) > 600 OR n > 60""")
def admission_bounds(spark: SparkSession, d: str) -> DataFrame:
    return screened(spark, d).select("trace_id", filters.admission(F.col("original_query"), 600, 60).alias("refused")).where("refused is not null")


@query("""SELECT user_id, '10.' || (user_id % 7) || '.' || (user_id % 11) || '.0/24' AS network FROM (SELECT DISTINCT user_id FROM events)""")
def network_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select("user_id").distinct()
    address = F.concat(F.lit("10."), F.col("user_id") % 7, F.lit("."), F.col("user_id") % 11, F.lit("."), F.col("user_id") % 250)
    return u.select("user_id", tx.network(address).alias("network"))


@query("""WITH r AS (SELECT content_hash, filename, length(filename)::DOUBLE AS n FROM doc_registry WHERE filename IS NOT NULL),
c AS (SELECT content_hash, ch, count(*)::DOUBLE AS c FROM (SELECT content_hash, unnest(string_split(filename, '')) AS ch FROM r) GROUP BY ALL)
SELECT content_hash, trim(regexp_replace(lower(regexp_replace(any_value(filename), '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, round(-sum(c / n * log2(c / n)), 4) AS bits FROM r JOIN c USING (content_hash) GROUP BY content_hash""")
def filename_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of file names, and the entropy of their characters."""
    r = table(spark, d, "doc_registry").where("filename is not null")
    return r.select("content_hash", tx.slug(F.col("filename")).alias("slug"), F.round(vx.entropy(F.col("filename")), 4).alias("bits"))




@query()
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Training questions that do not occur, word for word, among the held-out ones."""
    return datasets.excluded(table(spark, d, "qa").where("question is not null"), "question", table(spark, d, "qa_heldout").where("question is not null"), "question").select("id")


@query("""SELECT split, source, sum(n)::BIGINT AS rows, max(CASE WHEN l = 'true' THEN n END) AS answerable FROM (SELECT split, source, coalesce(answerable::VARCHAR, 'unknown') AS l, count(*) AS n FROM (SELECT split, source, answerable FROM qa UNION ALL SELECT split, source, answerable FROM qa_heldout) GROUP BY ALL) GROUP BY ALL""")
def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "qa").select("split", "source", "answerable").unionByName(table(spark, d, "qa_heldout").select("split", "source", "answerable"))
    return datasets.manifest(both, ["split", "source"], "answerable").select("split", "source", "rows", F.try_element_at("by_label", F.lit("true")).alias("answerable"))


@query()
def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    """Questions cut 80/10/10 within each source by a seeded order."""
    q = table(spark, d, "qa").select("id", "source").dropDuplicates(["id"])
    return datasets.split(q, "id", {"train": 0.8, "dev": 0.1, "test": 0.1}, 7, ["source"])


@query()
def hidden_attacks(spark: SparkSession, d: str) -> DataFrame:
    attacks = screened(spark, d).where("action = 'BLOCK'").select("trace_id", "original_query")
    carriers = table(spark, d, "heldout_passages").where("lang = 'en'").select("passage")
    return datasets.hidden(attacks, carriers, "trace_id", "original_query", "passage")


@query()
def bootstrap_latency(spark: SparkSession, d: str) -> DataFrame:
    """95 % intervals of the mean time an action."""
    t = screened(spark, d).where("execution_time_ms > 0 and not isnan(execution_time_ms)")
    return evaluation.bootstrap_mean(t, ["action"], "execution_time_ms", "trace_id")


@query("""SELECT DISTINCT o_orderkey AS id, o_totalprice > 200000 AS labelled FROM orders""".replace("o_totalprice > 200000", "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND epoch(o_orderdate::TIMESTAMP)::BIGINT < epoch(l.l_shipdate::TIMESTAMP)::BIGINT + 86400 AND epoch(o_orderdate::TIMESTAMP)::BIGINT + 864000 > epoch(l.l_shipdate::TIMESTAMP)::BIGINT)"))
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Interval overlap within a key: orders with an item shipped in the ten days after them."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("start")).withColumn("end", F.col("start") + 864000)
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 86400)
    return evaluation.span_hits(o, li, "id").select("id", "labelled").distinct()


@query()
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    """What a scanner reads of each document, as a hash."""
    return spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null")).select("doc_id", F.md5(tx.for_scan(F.col("text"))).alias("plain"), tx.language(F.col("text")).alias("language"))


@query("SELECT DISTINCT trace_id, original_query IS NOT NULL AS restored FROM threat_results WHERE action = 'FLAG' AND length(original_query) >= 16")
def decode_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Flagged messages encoded as Base64 and decoded again."""
    t = spread(table(spark, d, "threat_results").where("action = 'FLAG' and length(original_query) >= 16").select("trace_id", "original_query").distinct())
    return t.select("trace_id", (decoded(encoded(F.col("original_query"), "base64"))["text"] == F.col("original_query")).alias("restored"))


@query()
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into overlapping chunks of 220 words at paragraph, line and sentence ends."""
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Tables of candidates as a summary view and one view a row, with a common parent."""
    return chunking.table_views(candidates(spark, d).where("content like '%|%'"), "candidate_id", "content")


@query()
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """First and last lines, digits masked, that recur over the pages of a file (candidates of one file, in order of their chunk)."""
    return chunking.running_lines(candidates(spark, d).where("source is not null"), "source", "candidate_id", "content")
