"""Hash-chained logs, sampling of answer logs, and minimised records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def digest(previous: Column, *fields: Column) -> Column:
    """SHA-256 over the previous hash and the fields, each as text (null as empty), separated so that they cannot run together."""
    return F.sha2(F.concat_ws("\x1f", previous, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def sealed(df: DataFrame, chain: str, position: str, fields: list[str]) -> DataFrame:
    """Records with ``prev`` and ``hash``: each hash covers the record and the hash before it.

    A chain is sequential by nature; chains (one a tenant, day or writer) are sealed in parallel. A chain's records are kept together and in order and
    pass through with one hash of state, so a chain of any length needs no memory. Positions are unique within a chain.
    """
    text = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"__f{i}") for i, f in enumerate(fields)]
    extra = [f"__f{i}" for i in range(len(fields))]

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, prev = None, GENESIS
        for b in batches:
            seen, out = [], []
            for k, values in zip(b["__k"].tolist(), b[extra].itertuples(index=False)):
                if k != current:
                    current, prev = k, GENESIS
                seen.append(prev)
                prev = hashlib.sha256("\x1f".join([prev, *values]).encode()).hexdigest()
                out.append(prev)
            yield b.drop(columns=[*extra, "__k"]).assign(prev=seen, hash=out)

    schema = T.StructType([*df.schema.fields, T.StructField("prev", T.StringType()), T.StructField("hash", T.StringType())])
    key = F.coalesce(F.concat(F.lit("="), F.col(chain).cast("string")), F.lit("")).alias("__k")
    return df.select("*", *text, key).repartition(chain).sortWithinPartitions(chain, position).mapInPandas(seal, schema)


def broken(df: DataFrame, chain: str, position: str, fields: list[str]) -> DataFrame:
    """(chain, records, first_broken): the first record whose hash or link is wrong, null for an intact chain. One window, no fold."""
    w = Window.partitionBy(chain).orderBy(position)
    bad = (F.col("hash") != digest(F.col("prev"), *[F.col(f) for f in fields])) | (F.col("prev") != F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)))
    return df.withColumn("__bad", F.coalesce(bad, F.lit(True))).groupBy(chain).agg(F.count("*").alias("records"), F.min(F.when(F.col("__bad"), F.col(position))).alias("first_broken"))


def sample_reasons(decision: Column, retries: Column, statuses: Column, confidences: Column, threshold: float = 0.60, margin: float = 0.05) -> Column:
    """Why an answer is worth a reviewer's look: rejected, retried, failed_claim, near_threshold."""
    near = F.exists(confidences, lambda c: F.abs(c - threshold) <= margin + 1e-9)
    return F.array_compact(F.array(F.when(decision == "REJECT", F.lit("rejected")), F.when(retries > 0, F.lit("retried")), F.when(F.exists(statuses, lambda s: s != "ENTAILMENT"), F.lit("failed_claim")), F.when(near, F.lit("near_threshold"))))


def sampled(df: DataFrame, reasons: str, query_id: str, position: str, most: int = 500) -> DataFrame:
    """The first ``most`` records with any reason in file order, one a query."""
    first = F.row_number().over(Window.partitionBy(query_id).orderBy(position))
    return df.where(F.size(reasons) > 0).withColumn("__n", first).where("__n = 1").drop("__n").orderBy(position).limit(most)


def minimised(text: Column) -> Column:
    """struct<sha256, chars>: a text's hash and length in place of the text."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.length(text).alias("chars"))


def newest(df: DataFrame, position: str, n: int) -> DataFrame:
    """The newest n records, oldest first."""
    return df.orderBy(F.desc(position)).limit(n).orderBy(position)
