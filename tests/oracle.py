"""Comparison of a query's rows with those of its SQL in DuckDB."""

import datetime
import math
import os

import pandas as pd


def connect(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "null" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(v)[:10]
    return str(v)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


def check(query, sql, spark, folder, connection):
    a, b = query(spark, folder).toPandas(), connection.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert rows(a, columns) == rows(b, columns)
