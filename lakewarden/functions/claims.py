"""Text forms around drafted answers: attributions, draft lines, release rules, quotes, chart labels, tolerant JSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import text as tx

#: Clauses that say where a statement comes from (fixed values), in the order they are removed.
ATTRIBUTIONS = (
    r"(?i)^\s*(?:according to|based on|as (?:stated|noted|described|per)(?: in| by)?|per)\s+[^,]{1,80},\s*",
    r"(?i)\s*,?\s*(?:according to|as (?:stated|noted|described) in|as per)\s+[^,.;]{1,80}(?=[.;]?\s*$)",
    r"(?i)\s*\((?:source|see|from)[:\s][^)]{1,80}\)",
    r"(?i)\b(?:in|from|of)\s+[\w\-]+\.(?:pdf|docx|txt|md)\b",
    r"(?i)\b[\w\-]+\.(?:pdf|docx|txt|md)\b",
)
#: Nouns that end the name of a document (fixed values).
DOCUMENT_NOUNS = ("policy", "handbook", "report", "plan", "manual", "guide", "agreement", "summary", "schedule")
ABSTENTIONS = r"(?i)\b(?:i (?:do not|don't) (?:know|have)|not (?:enough|sufficient) (?:information|evidence)|cannot (?:answer|be answered|find)|no (?:information|evidence) (?:is |was )?(?:available|found|provided))\b"
DRAFT = T.StructType([
    T.StructField("analysis", T.StringType()),
    T.StructField("lines", T.ArrayType(T.StructType([
        T.StructField("prefix", T.StringType()),
        T.StructField("sentences", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("evidence_ids", T.ArrayType(T.StringType())), T.StructField("checkable", T.BooleanType())]))),
    ]))),
])
_CITED = re.compile(tx.CITED)
#: A sentence with the citations behind its end.
_SENTENCE = re.compile(r"\S(?:(?![.!?]\s).)*(?:[.!?](?=\s)(?:\s*\[[^\]\n]*\])*|.?$)", re.S)
_PREFIX = re.compile(r"^(\s*(?:[-*•]|\d{1,3}[.)]|#{1,6})\s+)")


def without_attribution(text: Column, fewest: int = 3) -> Column:
    """A statement without the clauses and file names that say where it is from; unchanged if fewer than ``fewest`` words would be left."""
    plain = text
    for pattern in ATTRIBUTIONS:
        plain = F.regexp_replace(plain, pattern, "")
    plain = F.trim(F.regexp_replace(plain, r"\s{2,}", " "))
    return F.when(F.size(tx.tokens(plain)) >= fewest, plain).otherwise(text)


def for_entailment(text: Column, longest: int = 6) -> Column:
    """A claim without the name of the document it opens with: "The Acme Security policy requires" becomes "The policy requires".

    The name is one to ``longest`` capitalised words between "The" and the first noun for a document.
    """
    w = F.split(text, " ")
    nouns = F.transform(F.slice(w, 1, longest + 2), lambda x: F.regexp_extract(x, "^[a-z]+", 0).isin(*DOCUMENT_NOUNS))
    at = F.array_position(nouns, True).cast("int")
    name = F.slice(w, 2, F.greatest(at - 2, F.lit(0)))
    named = (F.get(w, F.lit(0)) == "The") & (at >= 3) & F.forall(name, lambda x: x.rlike("^[A-Z]"))
    return F.when(named, F.concat_ws(" ", F.lit("The"), F.slice(w, F.greatest(at, F.lit(1)), F.size(w)))).otherwise(text)


def parse_draft(reply: str | None) -> tuple[str, list[dict]]:
    """(analysis, lines) of a model's reply: what stands behind ``ANSWER:``, line by line, in sentences with the evidence each cites."""
    if not reply:
        return "", []
    before, marker, body = reply.partition("ANSWER:")
    if not marker:
        before, body = "", reply
    lines = []
    for line in body.strip().split("\n"):
        if not line.strip():
            continue
        m = _PREFIX.match(line)
        prefix, rest = (m.group(1), line[m.end() :]) if m else ("", line.strip())
        sentences = []
        for m in _SENTENCE.finditer(rest):
            cited = [x for g in _CITED.findall(m.group()) for x in re.findall(r"E\d+", g)]
            plain = re.sub(r"\s+([.!?,;:])", r"\1", " ".join(_CITED.sub(" ", m.group()).split()))
            if plain:
                heading = prefix.lstrip().startswith("#") or plain.endswith(":") or re.fullmatch(r"\*\*.+\*\*", plain) is not None
                sentences.append({"text": plain, "evidence_ids": list(dict.fromkeys(cited)), "checkable": not heading})
        if sentences:
            lines.append({"prefix": prefix, "sentences": sentences})
    return before.strip(), lines


@F.pandas_udf(DRAFT)
def draft(reply: pd.Series) -> pd.DataFrame:
    rows = [parse_draft(r if isinstance(r, str) else None) for r in reply]
    return pd.DataFrame({"analysis": [a for a, _ in rows], "lines": [x for _, x in rows]})


def abstains(answer: Column) -> Column:
    """Whether an answer declines: it is missing or says that nothing is known."""
    return F.coalesce(answer.rlike(ABSTENTIONS), F.lit(True))


def structural(text: Column) -> Column:
    """Text that states nothing: no digits and at most eight words, ending in a colon or all a heading."""
    return ~text.rlike(r"\d") & (F.size(tx.tokens(text)) <= 8) & text.rlike(r"(?::\s*$|^\s*#{1,6}\s|^\s*\*\*[^*]+\*\*\s*$)")


def quote_words(text: Column) -> Column:
    """A quote as its lower-case ASCII words and numbers, one blank apart."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def quoted_in(quote: Column, passage: Column, fewest: int = 4) -> Column:
    """Whether a quote of at least ``fewest`` words stands in the passage word for word."""
    q = quote_words(quote)
    return (F.size(F.split(q, " ")) >= fewest) & F.concat(F.lit(" "), quote_words(passage), F.lit(" ")).contains(F.concat(F.lit(" "), q, F.lit(" ")))


def second_opinion(claim: Column, quote: Column, passage: Column, ranged: Column | None = None) -> Column:
    """A quote upholds a claim if the passage has it word for word and it holds the claim's numbers (those only ranged aside) and its polarity."""
    numbers = tx.numbers(claim)
    if ranged is not None:
        numbers = F.array_except(numbers, ranged)
    return quoted_in(quote, passage) & tx.contained(numbers, tx.numbers(quote)) & (tx.negations(claim) == tx.negations(quote))


def label_forms(label: Column) -> Column:
    """Ways a chart's label may stand in a text: itself, without a parenthesis, singular, and with an unabbreviated quarter."""
    low = F.trim(F.lower(label))
    bare = F.trim(F.regexp_replace(low, r"\s*\([^)]*\)", ""))
    return F.array_distinct(F.filter(F.array(low, bare, F.regexp_replace(bare, r"s$", ""), F.regexp_replace(bare, r"^q([1-4])\b", "quarter $1")), lambda x: x != ""))


def number_forms(value: Column) -> Column:
    """Ways a number may be written: plain, with thousands separators, with one or two places, and as a percentage of one."""
    whole = value == F.floor(value)
    plain = F.when(whole, F.format_string("%.0f", value)).otherwise(F.regexp_replace(F.format_string("%.6f", value), r"0+$", ""))
    return F.array_distinct(F.array(plain, F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2)), F.format_string("%.1f", value), F.format_string("%.2f", value), F.regexp_replace(F.format_string("%.2f", value * 100), r"\.?0+$", "")))


def json_in(reply: Column, schema: str) -> Column:
    """The first JSON object in a model's reply, under a schema; null if there is none or it is malformed."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def verdict(reply: Column) -> Column:
    """struct<injection, confidence, reason> of a judge's reply; anything unreadable, or a confidence outside [0, 1], is null."""
    raw = json_in(reply, "injection string, confidence string, reason string")
    flag = F.lower(raw["injection"])
    sure = raw["confidence"].try_cast("double")
    said = F.when(flag.isin("true", "yes", "1"), True).when(flag.isin("false", "no", "0"), False)
    return F.when(said.isNotNull() & sure.between(0, 1), F.struct(said.alias("injection"), sure.alias("confidence"), F.substring(raw["reason"], 1, 300).alias("reason")))


def code_digest(code: Column) -> Column:
    """SHA-256 of a code, blind to case, blanks and dashes."""
    return F.sha2(F.upper(F.regexp_replace(code, r"[\s-]", "")), 256)


def row_key(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, length)
