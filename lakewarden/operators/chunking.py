"""Cutting documents into chunks, tables into views, and finding running lines over pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators import verify
from lakewarden.runtime import spread

TARGET, OVERLAP = 220, 30
SEPARATORS = ("\n\n", "\n", ". ", " ")


def word_count(text: str) -> int:
    return len(text.split())


def cut(text: str, target: int = TARGET, overlap: int = OVERLAP, size: Callable[[str], int] = word_count) -> list[str]:
    """Chunks of at most ``target`` units: the coarsest separator that makes pieces fit, finer ones only inside pieces that do not.

    Each chunk after the first starts with the last pieces of the one before, up to ``overlap`` (a quarter of the target at most).
    """
    overlap = min(overlap, target // 4)

    def pieces(part: str, level: int) -> list[str]:
        if size(part) <= target:
            return [part] if part.strip() else []
        if level == len(SEPARATORS):
            step = max(1, len(part) * target // max(1, size(part) * 2))
            return [part[i : i + step] for i in range(0, len(part), step)] if size(part) > 1 else [part]
        bits = part.split(SEPARATORS[level])
        whole = [b + SEPARATORS[level] for b in bits[:-1]] + [bits[-1]]
        return [p for b in whole for p in (pieces(b, level + 1) if size(b) > target else ([b] if b.strip() else []))]

    out: list[str] = []
    held: list[tuple[str, int]] = []
    used = 0
    for p in pieces(text, 0):
        n = size(p)
        if held and used + n > target:
            out.append("".join(x for x, _ in held).strip())
            while held and (sum(k for _, k in held) > overlap or sum(k for _, k in held) + n > target):
                held.pop(0)
            used = sum(k for _, k in held)
        held.append((p, n))
        used += n
    if held:
        out.append("".join(x for x, _ in held).strip())
    return [c for c in out if c]


def chunks(docs: DataFrame, id_col: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_id, chunk_uid, content): chunks of each text in order; none for null and blank texts. Ids are content-addressed."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, n, c) for i, t in zip(b["id"], b["text"]) for n, c in enumerate(cut(t, target, overlap))], columns=[id_col, "chunk_id", "content"])

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null"))
    out = rows.mapInPandas(run, f"{id_col} {kind}, chunk_id int, content string")
    return out.withColumn("chunk_uid", F.concat_ws("_", F.sha2(F.col(id_col).cast("string"), 256), "chunk_id"))


def table_views(docs: DataFrame, id_col: str, text: str, most_rows: int = 400) -> DataFrame:
    """(id, parent_id, view_type, row_index, content): a summary and one statement a row of each table, under a common parent."""
    t = docs.select(id_col, F.posexplode(verify.tables(F.col(text))).alias("n", "t"))
    parent = F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.col("n").cast("string"), F.to_json("t")), 256)
    head = F.concat(F.lit("Table with columns "), F.array_join("t.headers", ", "), F.lit(" and "), F.size("t.rows"), F.lit(" rows."))
    stated = F.transform("t.rows", lambda r: F.concat(F.array_join(F.filter(F.zip_with("t.headers", r, lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c))), lambda x: x.isNotNull()), "; "), F.lit(".")))
    views = F.explode(F.concat(F.array(F.struct(F.lit("summary").alias("view_type"), F.lit(-1).alias("row_index"), head.alias("content"))), F.transform(stated, lambda s, i: F.struct(F.lit("row").alias("view_type"), i.alias("row_index"), s.alias("content")))))
    return t.select(id_col, parent.alias("parent_id"), (F.size("t.rows") > most_rows).alias("too_large"), views.alias("v")).select(id_col, "parent_id", "too_large", "v.*")


def running_lines(pages: DataFrame, document: str, page: str, text: str, share: float = 0.3, fewest: int = 3) -> DataFrame:
    """(document, line, pages): first or last lines, digits masked, on at least max(fewest, share) of a document's pages."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = pages.select(document, page, lines.alias("l")).where(F.size("l") > 0)
    edge = p.select(document, page, F.explode(F.array_distinct(F.transform(F.array(F.element_at("l", 1), F.element_at("l", -1)), lambda x: F.regexp_replace(x, r"\d+", "#")))).alias("line"))
    total = p.groupBy(document).agg(F.countDistinct(page).alias("total"))
    return edge.groupBy(document, "line").agg(F.countDistinct(page).alias("pages")).join(total, document).where(F.col("pages") >= F.greatest(F.lit(fewest), F.ceil(F.lit(share) * F.col("total")))).select(document, "line", "pages")


def sections(lines: DataFrame, document: str, position: str, level: str, text: str) -> DataFrame:
    """Body lines with the heading path above them: ``level`` is 0 for body, 1.. for headings; a heading ends the deeper ones."""
    w = Window.partitionBy(document).orderBy(position)
    out = lines
    names = []
    for k in range(1, 4):
        last = F.last(F.when((F.col(level) > 0) & (F.col(level) <= k), F.struct(F.col(level).alias("k"), F.col(text).alias("t"))), ignorenulls=True).over(w)
        out = out.withColumn(f"__h{k}", F.when(last["k"] == k, last["t"]))
        names.append(f"__h{k}")
    return out.where(F.col(level) == 0).withColumn("section", F.concat_ws(" > ", *names)).drop(*names)


def normalise_newlines(text: str) -> str:
    return re.sub(r"\r\n?", "\n", text)
