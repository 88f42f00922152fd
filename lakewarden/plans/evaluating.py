"""Queries of evaluation roll-ups, classifiers, claim forms and mutations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import claims as cl
from lakewarden.operators import learning, mutate, suites, verify
from lakewarden.plans.registry import query
from lakewarden.plans.reporting import SCREENED, screened
from lakewarden.plans.retrieval import CANDIDATES, candidates
from lakewarden.runtime import table


@query(f"""WITH r AS (SELECT policy_version AS config, CASE WHEN base_risk >= 0.3 THEN coalesce(corpus_version, 'unknown') ELSE 'benign' END AS family, CASE WHEN base_risk >= 0.3 THEN 'all attacks' ELSE 'all benign' END AS whole, action FROM {SCREENED}),
u AS (SELECT config, family, action FROM r UNION ALL SELECT config, whole, action FROM r)
SELECT config AS policy_version, family AS corpus_version, count(*) AS n, round(avg(CASE WHEN action <> 'PASS' THEN 1 ELSE 0 END), 6) AS flagged, round(avg(CASE WHEN action = 'BLOCK' THEN 1 ELSE 0 END), 6) AS blocked FROM u GROUP BY ALL""")
def screening_suite(spark: SparkSession, d: str) -> DataFrame:
    """Shares flagged and blocked a policy and corpus version, messages of some risk standing for attacks."""
    return suites.screening(screened(spark, d), "policy_version", "corpus_version", F.coalesce(F.col("base_risk") >= 0.3, F.lit(False)), "action")


@query(f"""WITH t AS (SELECT session_key, action, row_number() OVER (PARTITION BY session_key ORDER BY ts, trace_id) AS n FROM {SCREENED}), b AS (SELECT unnest([1, 5, 20]) AS budget),
p AS (SELECT budget, session_key, bool_or(action = 'PASS') AS u, bool_or(action = 'BLOCK') AS k, count(*) FILTER (action <> 'BLOCK') AS r, count(*) AS t FROM t, b WHERE n <= budget GROUP BY ALL)
SELECT budget::INTEGER AS budget, count(*) AS attacks, count(*) FILTER (u) AS undetected, count(*) FILTER (k) AS blocked, round(sum(r) / sum(t), 6) AS release_share FROM p GROUP BY budget""")
def attacker_campaigns(spark: SparkSession, d: str) -> DataFrame:
    s = screened(spark, d).withColumn("turn", F.struct("ts", "trace_id"))
    return suites.campaigns(s, "session_key", "turn", "action", [1, 5, 20])


@query(f"SELECT trace_id, count(*) AS claims, count(*) FILTER (trust_tier = 'TIER_1') AS verified, count(*) FILTER (trust_tier = 'QUARANTINE') AS contradicted, round(count(*) FILTER (trust_tier = 'TIER_1') / count(*), 6) AS ratio FROM {CANDIDATES} GROUP BY trace_id")
def grounding_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of passages of the first tier a question, in the place of verified claims."""
    s = F.when(F.col("trust_tier") == "TIER_1", "ENTAILMENT").when(F.col("trust_tier") == "QUARANTINE", "CONTRADICTION").otherwise("INSUFFICIENT")
    return suites.grounding(candidates(spark, d).withColumn("s", s), "trace_id", "s")


@query(f"""WITH p AS (SELECT trace_id, count(*) AS n, count(*) FILTER (NOT is_safe) AS k FROM {CANDIDATES} GROUP BY trace_id)
SELECT sum(n)::BIGINT AS sentences, sum(k)::BIGINT AS unsupported, round(sum(k) / sum(n), 6) AS pooled, round(avg(k / n), 6) AS per_answer FROM p""")
def unsupported_share(spark: SparkSession, d: str) -> DataFrame:
    return suites.unsupported(candidates(spark, d), "trace_id", ~F.col("is_safe"))


@query(f"""WITH c AS (SELECT element_type, CASE WHEN NOT is_authorized THEN 'authorization' WHEN NOT is_intact THEN 'integrity' WHEN NOT is_safe THEN 'safety' WHEN NOT has_provenance THEN 'provenance' ELSE 'other' END AS cause FROM {CANDIDATES} WHERE trust_tier <> 'TIER_1')
SELECT element_type, cause, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY element_type), 6) AS share FROM c GROUP BY element_type, cause""")
def drop_causes(spark: SparkSession, d: str) -> DataFrame:
    """Why passages are not of the first tier, by the first cause that holds."""
    c = candidates(spark, d).where("trust_tier <> 'TIER_1'")
    return suites.drop_causes(c, [("authorization", ~F.col("is_authorized")), ("integrity", ~F.col("is_intact")), ("safety", ~F.col("is_safe")), ("provenance", ~F.col("has_provenance"))], ["element_type"])


@query("""WITH l AS (SELECT DISTINCT trace_id, status, execution_time_ms AS v FROM layer2_results WHERE execution_time_ms > 0 AND NOT isnan(execution_time_ms) AND execution_time_ms < 'inf'::DOUBLE)
SELECT status, count(v) AS runs, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS spread, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99 FROM l GROUP BY status""")
def component_latency(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "layer2_results").where("execution_time_ms > 0 and not isnan(execution_time_ms) and execution_time_ms < double('inf')").select("trace_id", "status", "execution_time_ms").distinct()
    return suites.component_latency(t, "status", "execution_time_ms")


@query("""WITH q AS (SELECT DISTINCT ON (id) split, facts, wrong, coalesce(reference, '') AS a, reference IS NULL AS ab FROM qa),
f AS (SELECT *, len(list_filter(coalesce(facts, []), lambda x: len(list_filter(x, lambda y: contains(lower(a), lower(y)))) > 0)) AS found, len(coalesce(facts, [])) AS wanted, len(list_filter(coalesce(wrong, []), lambda y: contains(lower(a), lower(y)))) > 0 AS bad FROM q)
SELECT split, count(*) AS n, round(sum(found) / sum(wanted), 6) AS fact_recall, round(avg(CASE WHEN found = wanted THEN 1 ELSE 0 END), 6) AS all_facts, count(*) FILTER (bad) AS wrong_claims, count(*) FILTER (ab) AS abstentions FROM f GROUP BY split""")
def answer_suite(spark: SparkSession, d: str) -> DataFrame:
    """Reference texts held against facts and wrong claims, as answers would be."""
    return suites.answers(table(spark, d, "qa").dropDuplicates(["id"]), "split", "reference", "facts", "wrong", F.col("reference").isNull())


@query()
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    v = lambda name: c.select("candidate_id", F.col(name).alias("ok"))
    return suites.judges(v("is_safe"), v("is_intact"), v("has_provenance"), "candidate_id", "ok")


@query()
def embedding_classifier(spark: SparkSession, d: str) -> DataFrame:
    """A balanced logistic regression of label 0 against the rest, with each item's probability."""
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    w, b = learning.train(e, "embedding", "y")
    return e.select("vec_id", "y", F.round(learning.probability(F.col("embedding"), w, b), 4).alias("p"))


@query("""SELECT DISTINCT ON (trace_id) trace_id, regexp_replace(original_query, '(?i)\\b(ignore)\\b', 'disregard', 'g') <> original_query AS changed, true AS restored FROM threat_results WHERE action = 'BLOCK' AND original_query IS NOT NULL AND strlen(original_query) = length(original_query)""")
def mutation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Blocked ASCII messages in look-alike letters read as before, and whether a rewording applies."""
    t = screened(spark, d).where("action = 'BLOCK' and octet_length(original_query) = length(original_query)")
    q = F.col("original_query")
    return t.select("trace_id", (F.regexp_replace(q, r"(?i)\b(ignore)\b", "disregard") != q).alias("changed"), (mutate.restored(mutate.mutated(q, "homoglyph")) == mutate.restored(q)).alias("restored"))


@query("""SELECT response_id, array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[(E\\d+(?:\\s*,\\s*E\\d+)*)\\]', 1), lambda m: string_split_regex(m, '\\s*,\\s*'))))), ',') AS cited FROM (SELECT DISTINCT ON (response_id) response_id, answer FROM query_responses)""")
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "query_responses").dropDuplicates(["response_id"])
    return r.select("response_id", F.array_join(F.array_sort(verify.citations(F.col("answer"))), ",").alias("cited"))


@query()
def quoted_answers(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of answers that a passage of their trace holds word for word, with the claim's numbers and polarity."""
    a = table(spark, d, "query_responses").where("answer is not null").dropDuplicates(["response_id"])
    s = a.select("response_id", "trace_id", F.posexplode(verify.sentences_marked(verify.without_citations(F.col("answer")))).alias("n", "s")).select("response_id", "trace_id", "n", F.col("s.text").alias("t"))
    j = s.join(candidates(spark, d).select("trace_id", "candidate_id", "content"), "trace_id")
    return j.where(cl.second_opinion(F.col("t"), F.col("t"), F.col("content"))).select("response_id", "n", "candidate_id")


@query()
def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers as drafts: lines, sentences, cited evidence, and the statement without attribution."""
    a = table(spark, d, "query_responses").where("answer is not null").dropDuplicates(["response_id"]).select("response_id", cl.draft(F.col("answer")).alias("d"))
    x = a.select("response_id", F.posexplode("d.lines").alias("line", "l")).select("response_id", "line", F.posexplode("l.sentences").alias("n", "s"))
    return x.select("response_id", "line", "n", cl.without_attribution(F.col("s.text")).alias("claim"), F.array_join("s.evidence_ids", ",").alias("cited"), "s.checkable")
