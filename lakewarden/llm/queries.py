"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import leaks, mixing, nearcopies, overlaps, percentiles, pii, scans, splitting
from lakewarden.runtime import table

QUANTILES = [0.5, 0.9, 0.95, 0.99]


def _near_copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nearcopies.near_copies(table(spark, d, "candidates"), "candidate_id", "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of candidates whose contents share at least 70 % of their words."""
    pairs = nearcopies.expanded(*_near_copies(spark, d))
    return pairs.select(F.col("a").alias("candidate_id_a"), F.col("b").alias("candidate_id_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a candidate: its class and the number of other contents it is similar to."""
    return nearcopies.classes(*_near_copies(spark, d)).withColumnRenamed("id", "candidate_id")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlaps(table(spark, d, "qa_heldout").withColumnRenamed("id", "heldout"), table(spark, d, "qa"), "heldout", "id", "question")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.col("heldout").alias("heldout_id"), F.col("id").alias("qa_id"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping held-out questions, number and share, a held-out split and source."""
    hit = _overlaps(spark, d).select("heldout").distinct().withColumn("hit", F.lit(1))
    asked = table(spark, d, "qa_heldout").select(F.col("id").cast("string").alias("heldout"), "split", "source").distinct()
    per = asked.join(hit, "heldout", "left").groupBy("split", "source").agg(F.count("*").alias("questions"), F.count("hit").alias("overlapping"))
    return per.withColumn("share", F.col("overlapping") / F.col("questions"))


def timings(spark: SparkSession, d: str, name: str, kind: str) -> DataFrame:
    """(trace_id, tenant_id, kind, policy_version, day, ms): each record once, however often it arrived."""
    rows = table(spark, d, name)
    policy = F.col("policy_version") if "policy_version" in rows.columns else F.lit(None).cast("string")
    return rows.select("trace_id", "tenant_id", F.col(kind).alias("kind"), policy.alias("policy_version"), F.to_date("evaluated_at").alias("day"), F.col("execution_time_ms").alias("ms")).distinct()


def _rounded(df: DataFrame) -> DataFrame:
    """Percentiles to six places, beyond which two engines' powers may differ."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


KEYS = ["tenant_id", "kind", "policy_version", "day"]


def p3_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles a tenant, action or status, policy version and day, of both tables."""
    parts = []
    for name, kind in (("threat_results", "action"), ("layer2_results", "status")):
        parts.append(percentiles.summary(timings(spark, d, name, kind).withColumn("origin", F.lit(name)), ["origin", *KEYS], "ms"))
    return _rounded(percentiles.percentiles(parts[0].unionByName(parts[1]), ["origin", *KEYS], QUANTILES))


def p3_combined_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles a tenant and month, combined from the daily summaries."""
    daily = percentiles.summary(timings(spark, d, "threat_results", "action"), KEYS, "ms")
    monthly = percentiles.merged(daily.withColumn("month", F.trunc("day", "month")), ["tenant_id", "month"])
    return _rounded(percentiles.percentiles(monthly, ["tenant_id", "month"], QUANTILES))


def policy_timings(spark: SparkSession, d: str, name: str, kind: str) -> DataFrame:
    """Timings with the policy version of their question: its own column, or that of threat_results by trace_id."""
    t = timings(spark, d, name, kind)
    if "policy_version" in table(spark, d, name).columns:
        return t
    known = table(spark, d, "threat_results").groupBy("trace_id").agg(F.max("policy_version").alias("policy_version"))
    return t.drop("policy_version").join(known, "trace_id", "left")


def _policy_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Daily summaries of both tables, mergeable into longer spans."""
    parts = [percentiles.summary(policy_timings(spark, d, name, kind).withColumn("origin", F.lit(name)), ["origin", *KEYS], "ms") for name, kind in (("threat_results", "action"), ("layer2_results", "status"))]
    return parts[0].unionByName(parts[1])


def p3_policy_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """As p3_daily_percentiles, with the policy version of both tables."""
    return _rounded(percentiles.percentiles(_policy_summaries(spark, d), ["origin", *KEYS], QUANTILES))


def p3_policy_months(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles a table, tenant, action or status, policy version and month, combined from the daily summaries of both tables."""
    keys = ["origin", "tenant_id", "kind", "policy_version", "month"]
    monthly = percentiles.merged(_policy_summaries(spark, d).withColumn("month", F.trunc("day", "month")), keys)
    return _rounded(percentiles.percentiles(monthly, keys, QUANTILES))


def p3_exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles a status, with values themselves as buckets."""
    return _rounded(percentiles.percentiles(percentiles.summary(timings(spark, d, "layer2_results", "status"), ["kind"], "ms", error=None), ["kind"], QUANTILES, error=None))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned candidates with their text as continuous paragraphs and what was repaired."""
    return scans.repaired(table(spark, d, "candidates"), "candidate_id", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_repaired(spark, d).select("candidate_id")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Records with personal information: what was found where, and the text with typed placeholders."""
    parts = []
    for origin, key, text in (("candidates", "candidate_id", "content"), ("query_responses", "response_id", "answer")):
        found = pii.personal(table(spark, d, origin), key, text)
        parts.append(found.select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("record_id"), "spans", "text"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row a record and kind of personal information in it."""
    return p5_redacted(spark, d).select("origin", "record_id", F.explode(F.array_distinct("spans.kind")).alias("kind")).distinct()


def _item_windows(spark: SparkSession, d: str) -> DataFrame:
    return leaks.contained(table(spark, d, "documents"), table(spark, d, "heldout_passages"), "doc_id", "text", "item_id", "passage")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an item: the operator's windows that prove equal."""
    return _item_windows(spark, d).where("edits = 0").select("item_id", "doc_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked: documents with an equal or a nearly equal window, and the most windows of the item that one document holds."""
    per = _item_windows(spark, d).groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"), F.countDistinct("item_pos").alias("windows"))
    return per.groupBy("item_id").agg(F.count_if(F.col("edits") == 0).alias("exact_documents"), F.count_if(F.col("edits") > 0).alias("near_documents"), F.max("windows").alias("most_windows"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_shares_of_everything(spark: SparkSession, d: str) -> DataFrame:
    """Shares at a total of about half of all tokens (an eighth of the bytes): sources too small for their target give all they may."""
    docs = table(spark, d, "documents")
    # one number decides the total; it is read before the plan of the mixture is made
    total = docs.where("length(text) > 0").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return mixing.mixture(docs, table(spark, d, "mix_targets"), total_tokens=total // 8)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut: those of which there are pieces."""
    return p8_pieces(spark, d).select("doc_id").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), table(spark, d, "size_limits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_TIMES = """(SELECT DISTINCT trace_id, tenant_id, {kind} AS kind, {policy} AS policy_version, CAST(evaluated_at AT TIME ZONE 'UTC' AS DATE) AS day, execution_time_ms AS ms
  FROM {name})"""
_OK = "ms IS NOT NULL AND NOT isnan(ms) AND ms > 0 AND ms < 'inf'::DOUBLE"
_G = "(1.01::DOUBLE / 0.99::DOUBLE)"


def _percentile_sql(rows: str, keys: str, bucket: str, shown: str) -> str:
    picks = ", ".join(f"round(min(CASE WHEN cum >= greatest(ceil({q}::DOUBLE * total - 1e-9), 1) THEN {shown} END), 6) AS p{q * 100:g}" for q in QUANTILES)
    names = ", ".join(keys.split())
    return f"""WITH c AS (SELECT {names}, {bucket} AS bucket, count(*) AS n FROM ({rows}) WHERE {_OK} GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY {names} ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {names}) AS total FROM c)
SELECT {names}, CAST(max(total) AS BIGINT) AS n, {picks} FROM w GROUP BY {names}"""


#: Words of a text in SQL: invisible characters removed, the compatibility forms that occur in the tables replaced, lower case.
_FORMS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "º": "o", "ª": "a", "²": "2", "³": "3", "¹": "1", "½": "1⁄2", "…": "...", " ": " "}


def _words_sql(column: str) -> str:
    plain = f"regexp_replace({column}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    for a, b in _FORMS.items():
        plain = f"replace({plain}, '{a}', '{b}')"
    ascii_ = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "'")
    plain = f"translate({plain}, '{''.join(chr(ord(c) + 0xFEE0) for c in ascii_)}', '{ascii_}')"  # full-width forms
    return f"regexp_extract_all(lower(nfc_normalize({plain})), '[\\p{{L}}\\p{{N}}]+')"


_NEAR = f"""w AS (SELECT DISTINCT candidate_id AS id, list_sort({_words_sql("content")}) AS ws FROM candidates WHERE candidate_id IS NOT NULL AND content <> ''),
rep AS (SELECT ws, min(id) AS rep, len(ws) AS n FROM w WHERE len(ws) > 0 GROUP BY ws),
m AS (SELECT rep, x, count(*) AS k FROM (SELECT rep, unnest(ws) AS x FROM rep) GROUP BY ALL),
near AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.k, b.k)) AS s FROM m a JOIN m b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT a, b FROM near JOIN rep x ON x.rep = a JOIN rep y ON y.rep = b WHERE s >= 0.7 * (x.n + y.n - s)),
member AS (SELECT DISTINCT id, rep FROM w JOIN rep USING (ws))"""
_SAME = f"""h AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id, list_distinct({_words_sql("question")}) AS ws FROM qa_heldout),
q AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id, list_distinct({_words_sql("question")}) AS ws FROM qa),
pair AS (SELECT h.id AS heldout_id, q.id AS qa_id, h.ws AS a, q.ws AS b FROM h, q WHERE len(h.ws) > 0 AND len(q.ws) >= 0.75 * len(h.ws) AND len(h.ws) >= 0.75 * len(q.ws)),
found AS (SELECT DISTINCT heldout_id, qa_id FROM pair WHERE len(list_intersect(a, b)) >= 0.75 * (len(a) + len(b) - len(list_intersect(a, b))))"""


def _grams_sql(table_: str, key: str, column: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 11)) AS i FROM (SELECT {key}, {_words_sql(column)} AS ws FROM {table_}))"


def oracle_sql() -> dict[str, str]:
    threat = _TIMES.format(kind="action", policy="policy_version", name="threat_results")
    layer2 = _TIMES.format(kind="status", policy="NULL::VARCHAR", name="layer2_results")
    log_bucket, log_shown = f"ceil(ln(ms) / ln({_G}))", f"pow({_G}, bucket) * (2 / ({_G} + 1))"
    traced = f"SELECT l.trace_id, l.tenant_id, l.kind, t.policy_version, l.day, l.ms FROM {layer2} l LEFT JOIN (SELECT trace_id, max(policy_version) AS policy_version FROM threat_results GROUP BY trace_id) t USING (trace_id)"
    both = f"SELECT 'threat_results' AS origin, * FROM {threat} UNION ALL SELECT 'layer2_results', * FROM ({traced})"
    return {
        "p1_found": f"""WITH {_NEAR}, both_ways AS (SELECT a, b FROM links UNION ALL SELECT rep, rep FROM rep)
SELECT DISTINCT least(x.id, y.id) AS candidate_id_a, greatest(x.id, y.id) AS candidate_id_b FROM both_ways JOIN member x ON x.rep = a JOIN member y ON y.rep = b WHERE x.id <> y.id""",
        "p1_classes": f"""WITH RECURSIVE {_NEAR}, edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT rep, rep FROM rep UNION SELECT node, b FROM reach JOIN edge ON a = other),
class AS (SELECT node, min(other) AS class FROM reach GROUP BY node), count_ AS (SELECT a AS node, count(*) AS links FROM edge GROUP BY a)
SELECT id AS candidate_id, min(class) AS class, CAST(coalesce(sum(links), 0) AS BIGINT) AS links FROM member JOIN class ON rep = class.node LEFT JOIN count_ ON rep = count_.node GROUP BY id""",
        "p2_found": f"WITH {_SAME} SELECT * FROM found",
        "p2_report": f"""WITH {_SAME} SELECT split, source, count(*) AS questions, count(hit) AS overlapping, count(hit) / count(*) AS share
FROM (SELECT DISTINCT CAST(id AS VARCHAR) AS id, split, source FROM qa_heldout) LEFT JOIN (SELECT DISTINCT heldout_id AS hit FROM found) ON id = hit GROUP BY split, source""",
        "p6_found": f"WITH i AS ({_grams_sql('heldout_passages', 'item_id', 'passage')}), d AS ({_grams_sql('documents', 'doc_id', 'text')}) SELECT DISTINCT item_id, doc_id FROM i JOIN d USING (g)",
        # no tokenizer in SQL, but every text is well above or well below its limit in tokens of any: words and signs, a quarter more, or an eighth of its bytes decide alike
        "p8_found": "SELECT DISTINCT doc_id FROM documents JOIN size_limits USING (doc_type) WHERE greatest(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) * 1.25, octet_length(encode(text)) / 8) > max_tokens",
        "p3_policy_percentiles": _percentile_sql(both, "origin tenant_id kind policy_version day", log_bucket, log_shown),
        "p3_policy_months": _percentile_sql(f"SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM ({both})", "origin tenant_id kind policy_version month", log_bucket, log_shown),
        "p3_daily_percentiles": _percentile_sql(f"SELECT 'threat_results' AS origin, * FROM {threat} UNION ALL SELECT 'layer2_results', * FROM {layer2}", "origin tenant_id kind policy_version day", log_bucket, log_shown),
        "p3_combined_percentiles": _percentile_sql(f"SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM {threat}", "tenant_id month", log_bucket, log_shown),
        "p3_exact_percentiles": _percentile_sql(f"SELECT * FROM {layer2}", "kind", "ms", "bucket"),
    }
