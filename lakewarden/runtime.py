"""Session-level helpers: reading tables, spreading work, cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Spread rows over at least as many tasks as there are cores, only where the scan yields fewer.

    A large table arrives in many splits and passes through untouched; a small single-file table is shuffled once so that a
    following Python stage uses every core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *cols)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later stages neither recompute it nor depend on executors.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a local session uses a temporary one; on a cluster, whose executors share
    no such folder, it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lakewarden-"))
    return df.checkpoint(eager=True)
