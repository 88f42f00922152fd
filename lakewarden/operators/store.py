"""The document registry and its stores: versions, consistency, roll-ups, and changes as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_hash(tenant: Column, chunks: Column) -> Column:
    """SHA-256 of a tenant and its ordered chunk texts."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce(tenant, F.lit("default_tenant")), F.array_join(chunks, "\x1e", "")), 256)


def next_versions(new: DataFrame, registry: DataFrame, keys: tuple[str, str] = ("tenant_id", "document_id"), order: str = "ingested_at") -> DataFrame:
    """New entries with their version: one more than the highest existing version of (tenant, document), in arrival order among themselves."""
    known = registry.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("version").alias("__last"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return new.drop("version").withColumn("__n", n).join(known, same, "left").withColumn("version", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("int")).drop("__n", "__last", *[f"__{k}" for k in keys])


def consistency(registry_ids: DataFrame, keyword_ids: DataFrame, vector_ids: DataFrame, id_col: str) -> DataFrame:
    """One row of six counters over three stores that should hold the same ids.

    One shuffle on the id: each store is counted an id, then compared.
    """
    tag = lambda df, name: df.select(F.col(id_col).alias("id"), *[F.lit(int(name == s)).alias(s) for s in ("r", "k", "v")])
    both = tag(registry_ids, "r").unionByName(tag(keyword_ids, "k")).unionByName(tag(vector_ids, "v"))
    per = both.groupBy("id").agg(F.sum("r").alias("r"), F.sum("k").alias("k"), F.sum("v").alias("v"))
    real = F.col("id").isNotNull()
    return per.agg(
        F.count_if(real & (F.col("r") > 0) & (F.col("k") == 0)).alias("missing_in_keyword"),
        F.count_if(real & (F.col("r") > 0) & (F.col("v") == 0)).alias("missing_in_vector"),
        F.count_if(real & (F.col("r") == 0) & (F.col("k") > 0)).alias("unknown_in_keyword"),
        F.count_if(real & (F.col("r") == 0) & (F.col("v") > 0)).alias("unknown_in_vector"),
        F.coalesce(F.sum(F.when(~real, F.col("r") + F.col("k") + F.col("v"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(real, F.greatest(F.col("r") - 1, F.lit(0)) + F.greatest(F.col("k") - 1, F.lit(0)) + F.greatest(F.col("v") - 1, F.lit(0)))), F.lit(0)).alias("duplicate_ids"),
    )


def registry_rollup(chunks: DataFrame, key: str = "content_hash") -> DataFrame:
    """One registry entry a document: chunk counts, flagged count, ids in order and the hash of each chunk (a document's chunks are few)."""
    c = chunks.withColumn("__sha", F.sha2("content", 256))
    entry = F.struct(F.col("chunk_id").alias("n"), F.col("chunk_uid").alias("uid"), F.col("__sha").alias("sha"))
    g = c.groupBy(key).agg(F.count("*").alias("total_chunks"), F.count_if(F.col("scan_status") != "quarantined").alias("chunk_count"), F.count_if(F.col("scan_status") == "flagged").alias("flagged_count"), F.array_sort(F.collect_set(entry)).alias("__e"))
    return g.select(key, "total_chunks", "chunk_count", "flagged_count", F.transform("__e", lambda e: e["uid"]).alias("ids"), F.map_from_entries(F.transform("__e", lambda e: F.struct(e["uid"], e["sha"]))).alias("chunk_hashes"))


def inserted(registry: DataFrame, new: DataFrame, key: str = "content_hash") -> DataFrame:
    """The registry with the new entries whose content it does not hold yet; among new ones the first of a content wins."""
    fresh = new.join(registry.select(key), key, "left_anti").dropDuplicates([key])
    return registry.unionByName(fresh, allowMissingColumns=True)


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose keys are in ``gone``."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def reclassified(table: DataFrame, changes: DataFrame, key: str, column: str = "acl_tier") -> DataFrame:
    """The table with a column's new value where ``changes`` (key, column) names one."""
    new = changes.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    return table.join(new, F.col(key) == F.col("__k"), "left").withColumn(column, F.coalesce("__v", column)).drop("__k", "__v")


def backfilled(table: DataFrame, tenant: str = "tenant_id", tier: str = "acl_tier") -> DataFrame:
    """Default tenant and tier where they are missing; a second run changes nothing."""
    return table.withColumn(tenant, F.coalesce(F.when(F.col(tenant) != "", F.col(tenant)), F.lit("default_tenant"))).withColumn(tier, F.coalesce(F.col(tier), F.lit(1)))


def rebuild_order(files: DataFrame, registry: DataFrame, name: str = "filename") -> DataFrame:
    """Files to ingest again, in the order of their old versions; files the registry never knew are left out."""
    known = registry.groupBy(name).agg(F.min("version").alias("old_version"))
    return files.join(known, name).orderBy("old_version", name)


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are wanted but not there yet (cache misses)."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a table so that readers see the old or the new one: partitions are replaced as a whole, a failed job replaces none."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
