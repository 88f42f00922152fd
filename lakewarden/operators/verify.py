"""Checking statements against evidence: windows, numbers, ranges, negation, tables, charts, release and reconstruction."""

from __future__ import annotations

import re
from itertools import accumulate, groupby, pairwise
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import text as tx

TABLE = T.ArrayType(T.StructType([T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))
SENTENCE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("is_row", T.BooleanType())]))
#: A pipe table among trimmed lines: a line of cells, a rule beneath it with at least one dash, and the lines of cells that follow.
_TABLE = re.compile(r"^(?P<head>\|.*)\n(?=[^\n]*-)[|:\- \t]+(?P<body>(?:\n\|.*)*)$", re.M)
#: What a line starts with that no wrapped sentence goes on with: cells, a list mark, a number, or a label of up to four words.
_OPENING = re.compile(r"[|*•-]|\d+[.)]\s|[A-Z]\w*(?: \w+){0,3}:\s")
#: What a line ends with if its sentence ends there.
_CLOSED = re.compile(r"[.!?:;]$")


def _row(line: str) -> list[str]:
    return list(map(str.strip, line.removeprefix("|").removesuffix("|").split("|")))


def _trimmed(text: str, blank: bool) -> str:
    """The lines without blanks at their ends; blank lines stay only if asked."""
    return "\n".join(x for x in map(str.strip, text.splitlines()) if x or blank)


def parse_tables(text: str) -> list[dict]:
    """Pipe tables of a text, rows cut or filled to the width of their header."""
    found = []
    for m in _TABLE.finditer(_trimmed(text, blank=True)):
        head = _row(m["head"])
        rows = map(_row, m["body"].split("\n")[1:])
        found.append({"headers": head, "rows": [[r[i] if i < len(r) else "" for i in range(len(head))] for r in rows]})
    return found


def _wrapped(before: str, after: str) -> bool:
    """Whether a line break stands within a sentence: four words or more that end nothing, no path of titles, and nothing new begins."""
    return len(before.split()) >= 4 and not _CLOSED.search(before) and " > " not in before and before[0] != "|" and not _OPENING.match(after)


def _prose(block: str) -> list[str]:
    """Sentences of a block without tables: lines are numbered by the hard breaks before them, and lines of one number are one text."""
    lines = block.splitlines()
    if not lines:
        return []
    numbers = accumulate((not _wrapped(x, y) for x, y in pairwise(lines)), initial=0)
    texts = (" ".join(line for _, line in part) for _, part in groupby(zip(numbers, lines), key=itemgetter(0)))
    return [s for t in texts for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s]


def marked_sentences(text: str) -> list[tuple[str, bool]]:
    """Sentences of wrapped text, table rows as ``header: cell; ...`` statements of their own (True)."""
    clean, at, found = _trimmed(text, blank=False), 0, []
    for m in _TABLE.finditer(clean):
        found += [(s, False) for s in _prose(clean[at : m.start()])]
        head = _row(m["head"])
        for line in m["body"].split("\n")[1:]:
            named = [f"{h}: {c}" for h, c in zip(head, _row(line)) if c]
            found.append(("; ".join(named) + ".", True))
        at = m.end()
    return found + [(s, False) for s in _prose(clean[at:])]


@F.pandas_udf(TABLE)
def tables(text: pd.Series) -> pd.Series:
    return text.map(lambda t: parse_tables(t) if t else [])


@F.pandas_udf(SENTENCE)
def sentences_marked(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"text": s, "is_row": r} for s, r in marked_sentences(t)] if t else [])


def windows(sentences: Column) -> Column:
    """Claim windows: each sentence, and each pair of neighbours neither of which is a table row."""
    one = F.transform(sentences, lambda s: s["text"])
    n = F.size(sentences)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.transform(F.filter(at, lambda i: ~F.element_at(sentences, i)["is_row"] & ~F.element_at(sentences, i + 1)["is_row"]), lambda i: F.concat_ws(" ", F.element_at(sentences, i)["text"], F.element_at(sentences, i + 1)["text"]))
    return F.concat(one, pair)


def word_windows(text: Column, size: int = 40, stride: int = 20) -> Column:
    """Windows of ``size`` words every ``stride``; the first that reaches the end is the last."""
    w = tx.tokens(text)
    n = F.size(w)
    last = F.when(n <= size, F.lit(0)).otherwise((F.ceil((n - size) / F.lit(float(stride))) * stride).cast("int"))
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last, F.lit(stride)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))


def best_windows(claims: DataFrame, evidence: DataFrame, group: str, claim: str, claim_text: str, source: str, window_text: str, cited: str | None = None, k: int = 12) -> DataFrame:
    """The k windows of a question that fit a claim best: word overlap, 0.15 more if cited, a little less a word of length.

    Claims meet the windows of their own question; WindowGroupLimit keeps k a claim before the shuffle is sorted.
    """
    c = claims.withColumn("__t", tx.terms(F.col(claim_text)))
    e = evidence.withColumn("__wt", tx.terms(F.col(window_text)))
    bonus = F.when(F.array_contains(F.col(cited), F.col(source)), F.lit(0.15)).otherwise(0.0) if cited else F.lit(0.0)
    score = tx.overlap(F.col("__t"), F.col("__wt")) + bonus - F.lit(0.0005) * F.size(tx.tokens(F.col(window_text)))
    rank = F.row_number().over(Window.partitionBy(group, claim).orderBy(F.desc("score"), source, window_text))
    return c.join(e, group).withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k).drop("__t", "__wt")


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of a claim that the evidence neither writes nor spans by a stated range."""
    spans = tx.ranges(evidence)
    return F.filter(F.array_except(tx.numbers(claim), tx.numbers(evidence)), lambda n: ~tx.in_ranges(n, spans))


def extractive(claim: Column, window: Column, coverage: float = 0.9) -> Column:
    """A near-verbatim claim: at least two content words, ``coverage`` of them and all numbers in the window, negations alike."""
    words = tx.terms(claim)
    return (F.size(words) >= 2) & (tx.overlap(words, tx.terms(window)) >= coverage) & tx.contained(tx.numbers(claim), tx.numbers(window)) & (tx.negations(claim) == tx.negations(window))


def decision(numbers_ok: Column, table: Column, extract: Column, entail: Column, contradict: Column, topical: Column, threshold: float = 0.60) -> Column:
    """struct<status, confidence>: numbers, table check, extraction, then a model's scores; contradictions count only on topic (0.4)."""
    out = lambda s, c: F.struct(F.lit(s).alias("status"), F.round(c, 4).alias("confidence"))
    e, c = F.coalesce(entail, F.lit(0.0)), F.coalesce(contradict, F.lit(0.0))
    return (
        F.when(~F.coalesce(numbers_ok, F.lit(False)), out("INSUFFICIENT", F.lit(0.0)))
        .when(F.coalesce(table, F.lit(False)), out("ENTAILMENT", F.lit(0.95)))
        .when(F.coalesce(extract, F.lit(False)), out("ENTAILMENT", F.lit(0.9)))
        .when(e >= threshold, out("ENTAILMENT", e))
        .when((c >= 0.60) & (F.coalesce(topical, F.lit(0.0)) >= 0.4), out("CONTRADICTION", c))
        .otherwise(out("INSUFFICIENT", e))
    )


UNIT_MINUTES = {"minute": 1, "minutes": 1, "min": 1, "hour": 60, "hours": 60, "day": 1440, "days": 1440, "week": 10080, "weeks": 10080}


def cell_value(cell: Column) -> Column:
    """A table cell as a number, time spans in minutes; null for texts and for spans of numbers."""
    number = F.regexp_extract(cell, r"(\d[\d,]*\.?\d*)", 1)
    unit = F.lower(F.regexp_extract(cell, r"\d\s*([A-Za-z]+)", 1))
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_MINUTES.items() for x in kv]), unit), F.lit(1))
    several = F.regexp_count(cell, F.lit(r"\d[\d,]*\.?\d*")) != 1
    return F.when(~several, F.replace(number, F.lit(",")).try_cast("double") * factor)


def table_cells(df: DataFrame, keys: list[str], table_col: str) -> DataFrame:
    """(keys..., table_no, row_no, name, column, cell, value): one row a cell outside the first column, which names the rows."""
    t = df.select(*keys, F.posexplode(table_col).alias("table_no", "t"))
    r = t.select(*keys, "table_no", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_no", "cells"))
    c = r.select(*keys, "table_no", "row_no", F.element_at("cells", 1).alias("name"), F.posexplode(F.arrays_zip("headers", "cells")).alias("column_no", "hc"))
    return c.where("column_no > 0").select(*keys, "table_no", "row_no", "name", "column_no", F.col("hc.headers").alias("column"), F.col("hc.cells").alias("cell"), cell_value(F.col("hc.cells")).alias("value"))


def extremes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., table_no, column, highest, lowest): the row with the unique extreme of each numeric column; null where it is shared."""
    g = cells.where("value is not null").groupBy(*keys, "table_no", "column").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    x = cells.join(g, [*keys, "table_no", "column"])
    only = lambda at: F.when(F.count_if(F.col("value") == F.col(at)) == 1, F.max(F.when(F.col("value") == F.col(at), F.col("name"))))
    return x.groupBy(*keys, "table_no", "column").agg(only("hi").alias("highest"), only("lo").alias("lowest"))


def superlative_holds(claim: Column, column: Column, highest: Column, lowest: Column) -> Column:
    """Whether a claim that names a column and says highest or lowest names the one row that has it; null if it claims no such thing."""
    low = F.lower(claim)
    names = lambda row: low.contains(F.lower(row))
    up, down = low.rlike(r"\b(highest|largest|most|longest|greatest|maximum)\b"), low.rlike(r"\b(lowest|smallest|least|shortest|fewest|minimum)\b")
    about = low.contains(F.lower(column))
    return F.when(about & up & ~down, F.coalesce(names(highest), F.lit(False))).when(about & down & ~up, F.coalesce(names(lowest), F.lit(False)))


#: Units a value may carry (fixed values); plural and singular count alike, as do signs and codes of a currency.
UNITS = r"(?i)(%|percent\b|\$|usd\b|€|eur\b|£|gbp\b|\bcredits?\b|\bminutes?\b|\bhours?\b|\bdays?\b|\bweeks?\b|\bmonths?\b|\byears?\b|\bkilobytes?\b)"
SAME_UNIT = {"percent": "%", "$": "usd", "€": "eur", "£": "gbp"}


def units(text: Column) -> Column:
    """Distinct units named in a text, each in one form."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNITS), F.lit(1)), lambda u: F.regexp_replace(F.lower(u), r"(?<=[a-z]{3})s$", ""))
    forms = F.create_map(*[F.lit(x) for kv in SAME_UNIT.items() for x in kv])
    return F.array_distinct(F.transform(found, lambda u: F.coalesce(F.try_element_at(forms, u), u)))


ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def row_named(claim: Column, name: Column, row_no: Column) -> Column:
    """Whether a claim speaks of a row: by its name, as a whole word, or by its place (the second row, row 2)."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(claim), r"[^\p{L}\p{N}%]+", " "), F.lit(" "))
    own = F.concat(F.lit(" "), F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}%]+", " "), F.lit(" "))
    place = F.element_at(F.array(*map(F.lit, ORDINALS)), F.least(row_no, F.lit(len(ORDINALS) - 1)) + 1)
    by_place = low.contains(F.concat(F.lit(" "), place, F.lit(" row "))) & (row_no < len(ORDINALS)) | low.contains(F.concat(F.lit(" row "), (row_no + 1).cast("string"), F.lit(" ")))
    return F.coalesce(((F.trim(own) != "") & low.contains(own)) | by_place, F.lit(False))


def row_value_holds(claim: Column, name: Column, column: Column, cell: Column) -> Column:
    """Whether a claim about a named row and column states the cell's value in the cell's units; null if it does not name both.

    A cell with numbers must be stated number for number; a unit may be left out of the claim only if the column's name has it.
    """
    low = F.lower(claim)
    about = low.contains(F.lower(name)) & low.contains(F.lower(column)) & (F.length(name) > 0)
    stated = F.array_except(tx.numbers(claim), F.array_union(tx.numbers(name), tx.numbers(column)))
    cell_numbers = tx.numbers(cell)
    return F.when(about, F.when(F.size(cell_numbers) > 0, tx.contained(cell_numbers, stated) & tx.contained(stated, cell_numbers) & tx.contained(units(cell), F.array_union(units(claim), units(column))) & tx.contained(units(claim), F.concat(units(cell), units(column), units(name)))).otherwise(low.contains(F.lower(cell))))


def reconstructed(sentences: DataFrame, group: str, position: str, text: str, passed: str, heading: str) -> DataFrame:
    """(group, answer): the verified sentences in order; a heading stays only if a verified sentence follows before the next heading."""
    w = Window.partitionBy(group).orderBy(position)
    s = sentences.withColumn("__part", F.sum(F.col(heading).cast("int")).over(w))
    alive = F.max((~F.col(heading) & F.col(passed)).cast("int")).over(Window.partitionBy(group, "__part")) == 1
    kept = s.withColumn("__alive", alive).where(F.when(F.col(heading), F.col("__alive")).otherwise(F.col(passed)))
    line = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])  # the sentences of one answer
    return kept.groupBy(group).agg(F.array_join(line, "\n").alias("answer"))


def citations(text: Column) -> Column:
    """Evidence labels E1, E2, ... cited in brackets, in order of first use."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(tx.CITED), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"E\d+"), F.lit(0)))))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*" + tx.CITED, ""), r" {2,}", " "))


def chart_holds(points: Column, evidence: Column) -> Column:
    """Whether every point (label -> value) of a chart is stated by the evidence: its label as words and its value as a number."""
    low = F.lower(F.coalesce(evidence, F.lit("")))
    stated = F.transform(tx.numbers(evidence), lambda n: n.try_cast("double"))
    entries = F.map_entries(points)
    return (F.size(entries) >= 2) & F.forall(entries, lambda p: low.contains(F.lower(p["key"])) & F.exists(stated, lambda v: F.abs(v - p["value"]) < 1e-9))


def chart_outcome(made: Column, gold: Column) -> Column:
    """none, correct or wrong: same labels, each value within 0.05 + 0.1 % of the gold one."""
    near = F.forall(F.map_entries(gold), lambda g: F.coalesce(F.abs(F.try_element_at(made, g["key"]) - g["value"]) <= F.lit(0.05) + F.lit(0.001) * F.abs(g["value"]), F.lit(False)))
    return F.when(made.isNull() | (F.size(made) == 0), F.lit("none")).when((F.size(made) == F.size(gold)) & near, F.lit("correct")).otherwise(F.lit("wrong"))
