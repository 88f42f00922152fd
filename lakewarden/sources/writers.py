"""Sinks: appended logs, minimised audit records, Markdown and CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a claim's result that may be logged; the rest may hold text.
CLAIM_FIELDS = ("claim_id", "cited_evidence_ids", "supporting_evidence_id", "status", "confidence", "reason")
#: Keys whose values are texts and never logged (fixed values).
TEXT_KEYS = ("text", "content", "query", "question", "answer", "prompt", "passage", "evidence", "preview")


def append_log(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append records as JSON lines, partitioned if asked."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).json(path)


def scrubbed(df: DataFrame, deepest: int = 6) -> DataFrame:
    """A table without columns and nested fields that hold texts, doubles rounded to 4 places; structs beyond ``deepest`` levels are dropped.

    The schema decides, so nothing is parsed and the plan stays one projection.
    """
    from pyspark.sql import types as T

    def clean(c: Column, kind: T.DataType, level: int) -> Column | None:
        if isinstance(kind, T.StructType):
            if level >= deepest:
                return None
            inner = [(f.name, clean(c.getField(f.name), f.dataType, level + 1)) for f in kind.fields if f.name.lower() not in TEXT_KEYS]
            inner = [x.alias(n) for n, x in inner if x is not None]
            return F.when(c.isNotNull(), F.struct(*inner)) if inner else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if level >= deepest:
                return None
            return F.transform(c, lambda x: clean(x, kind.elementType, level + 1))
        return F.round(c, 4) if isinstance(kind, T.DoubleType) else c

    parts = [(f.name, clean(F.col(f.name), f.dataType, 0)) for f in df.schema.fields if f.name.lower() not in TEXT_KEYS]
    return df.select(*[c.alias(n) for n, c in parts if c is not None])


def minimised_claims(results: Column, safe_reasons: list[str]) -> Column:
    """Claim results with the allowed fields only, and reasons outside a fixed list replaced."""
    reason = lambda r: F.when(r["reason"].isin(safe_reasons), r["reason"]).otherwise(F.lit("withheld"))
    return F.transform(results, lambda r: F.struct(*[(reason(r) if f == "reason" else r[f]).alias(f) for f in CLAIM_FIELDS]))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report's table as Markdown, at most ``most`` rows of it: reports are read by people."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    shown = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join([head, *shown])


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
