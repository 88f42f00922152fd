"""Predicates: the metadata filter language, visibility, admission and sampling rules."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that stand in for a missing tenant and clearance tier (fixed values).
DEFAULTS: dict[str, Any] = {"tenant_id": "default_tenant", "acl_tier": 1}


def compile_filter(condition: Mapping[str, Any] | None, columns: Mapping[str, Column] | None = None, defaults: Mapping[str, Any] = DEFAULTS) -> Column:
    """A filter document as a column: ``{field: value}``, ``$and``, ``$or``, and ``$eq $ne $lt $lte $gt $gte $in $nin`` on a field.

    Several fields or operators of one document must all hold. Missing fields take their default, if they have one; ordered comparisons and
    membership of a missing value fail, ``$ne`` and ``$nin`` of one hold. The result is never null, and unknown operators raise ValueError. It is a
    plain expression, so it reaches the scan.
    """

    def of(name: str) -> Column:
        c = columns[name] if columns else F.col(name)
        return F.coalesce(c, F.lit(defaults[name])) if name in defaults else c

    def one(c: Column, op: str, value: Any) -> Column:
        if op == "$eq":
            return c.eqNullSafe(F.lit(value))
        if op == "$ne":
            return ~c.eqNullSafe(F.lit(value))
        if op in ("$in", "$nin"):
            inside = F.coalesce(c.isin(list(value)), F.lit(False)) if value else F.lit(False)
            return inside if op == "$in" else ~inside
        compare = {"$lt": c < F.lit(value), "$lte": c <= F.lit(value), "$gt": c > F.lit(value), "$gte": c >= F.lit(value)}
        if op not in compare:
            raise ValueError(f"unknown filter operator {op!r}")
        return F.coalesce(compare[op], F.lit(False))

    parts: list[Column] = []
    for key, value in (condition or {}).items():
        if key in ("$and", "$or"):
            inner = [compile_filter(x, columns, defaults) for x in value]
            joined = F.lit(key == "$and")
            for x in inner:
                joined = (joined & x) if key == "$and" else (joined | x)
            parts.append(joined)
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key!r}")
        elif isinstance(value, Mapping):
            parts += [one(of(key), op, v) for op, v in value.items()]
        else:
            parts.append(one(of(key), "$eq", value))
    result = F.lit(True)
    for p in parts:
        result = result & p
    return result


def visible(df: DataFrame, tenant: str | None, clearance: int) -> DataFrame:
    """Rows of a tenant (any for None) up to a clearance tier; missing tenant and tier take the defaults."""
    condition: dict[str, Any] = {"acl_tier": {"$lte": clearance}}
    if tenant is not None:
        condition["tenant_id"] = tenant
    return df.where(compile_filter(condition))


def authorized(tenant: Column, tier: Column, asked_tenant: Column | str, clearance: Column | int) -> Column:
    """Strict authorization: the tenant is present and equal, the tier readable and within the clearance (unreadable: 3)."""
    asked = F.lit(asked_tenant) if isinstance(asked_tenant, str) else asked_tenant
    level = F.coalesce(tier.cast("string").try_cast("int"), F.lit(3))
    return F.coalesce((tenant != "") & (tenant == asked) & (level <= (F.lit(clearance) if isinstance(clearance, int) else clearance)), F.lit(False))


def admission(query: Column, most_bytes: int = 32 * 1024, most_tokens: int = 1024) -> Column:
    """Why a query is refused before any analysis: empty, too_large, too_long; null if it is admitted."""
    words = F.size(F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(words == 0, F.lit("empty")).when(F.octet_length(query) > most_bytes, F.lit("too_large")).when(words > most_tokens, F.lit("too_long"))


def since(column: Column, span: str, now: Column | None = None) -> Column:
    """Rows at or after a relative (``30m``, ``24h``, ``7d``) or ISO time; unreadable times are kept."""
    m = re.fullmatch(r"(\d+)([mhd])", span.strip())
    at = F.try_to_timestamp(column) if not isinstance(column, str) else F.col(column)
    if m:
        unit = {"m": "MINUTES", "h": "HOURS", "d": "DAYS"}[m.group(2)]
        start = (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {m.group(1)} {unit}")
    else:
        start = F.lit(span).cast("timestamp")
    return F.coalesce(at >= start, F.lit(True))


def reason_code(reason: Column, codes: Mapping[str, str], other: str = "other") -> Column:
    """A free-text reason as the code of the first prefix it starts with."""
    found = F.when(reason.isNull(), F.lit(None).cast("string"))
    for prefix, code in codes.items():
        found = found.when(reason.startswith(prefix), F.lit(code))
    return found.otherwise(F.lit(other))


def valid_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))
