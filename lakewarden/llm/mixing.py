"""Mixing sources to target weights.

Each document gets a hash-random key; within a source the keys are cut into ranges, token sums of the ranges give the offsets, and a
running sum inside the one range where the budget ends gives the exact cut. Every other range is decided as a whole, so no source, however
large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm import tokens
from lakewarden.runtime import cut, spread

#: Key ranges a source; offsets are at most this many rows a target source.
RANGES = 1024


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, folder: str, seed: int, ranges: int = RANGES) -> DataFrame:
    """(id, source, tokens, key, range), one row a document; repeated ids are one document, null and empty texts none."""
    return (
        spread(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0"))
        .select("id", "source", tokens.token_count(F.col("text"), folder).alias("tokens"))
        .where("tokens > 0")
        .groupBy("id")
        .agg(F.max(F.struct("tokens", "source")).alias("d"))
        .select("id", "d.source", "d.tokens", F.xxhash64(F.lit(seed), "id").alias("key"))
        .withColumn("range", F.shiftright(F.shiftrightunsigned("key", 40) * F.lit(ranges), 24).cast("int"))  # in the order of the keys, read as unsigned
    )


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", folder: str = tokens.FOLDER, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Choose documents with their number of uses so that sources contribute their target shares.

    ``targets``: (source, target_share, max_repeats), one row a source; rows with a null or non-positive share are ignored, shares are
    taken relative to their sum over sources that have any tokens. Without ``total_tokens`` the total is the largest at which every such
    source can reach its share within its ``max_repeats``; with it, a source that is too small gives all it may and its actual share says so.
    A source's documents are taken in hash order: full epochs first, then the prefix whose size is nearest to what is left of the budget, so
    that a source misses its budget by at most half a document.

    Returns (documents: id, source, tokens, uses, used_tokens; shares: one row a target source). Documents of sources without a target, null ids and
    null or empty texts, are not chosen. Repeated ids count once (the longest text). Empty tables give empty results (shares of 0).
    """
    base = cut(sized(docs, id_col, text_col, source_col, folder, seed))
    # source is unique in targets and each row of it makes at most RANGES offsets: both are bounded by the table of targets
    goal = targets.where("target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sums = base.groupBy("source", "range").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    have = sums.groupBy("source").agg(F.sum("t").alias("available"), F.sum("n").alias("documents"))
    plan = goal.join(have, "source", "left").fillna(0, ["available", "documents"])
    everything = Window.partitionBy(F.lit(1))  # over the rows of the target table only
    plan = plan.withColumn("share", F.when(F.col("available") > 0, F.col("target_share")) / F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(everything))
    reach = F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(reach / F.col("share")).over(everything)
    plan = plan.withColumn("budget", F.least(F.floor(F.col("share") * total + F.lit(1e-6)), reach).cast("long"))
    plan = cut(plan.withColumn("epochs", F.expr("if(available > 0, budget div available, 0)")).withColumn("rest", F.expr("budget - epochs * available")))

    offsets = (
        sums.join(plan.select("source", "epochs", "rest"), "source")
        .withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("range")) - F.col("t"))
        .select("source", "range", "epochs", "rest", "before", F.expr("before + t <= rest").alias("whole"), F.expr("before < rest and before + t > rest").alias("split"))
    )
    rows = base.join(offsets, ["source", "range"])  # broadcast only where its measured size allows
    decided = rows.where(~F.col("split")).withColumn("extra", F.col("whole").cast("int"))
    # one range a source is split: the running sum sees 1/RANGES of a source at most
    inside = rows.where("split").withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "id"))).withColumn("extra", F.expr("int(upto - tokens / 2 <= rest)")).drop("upto")
    chosen = (
        decided.unionByName(inside)
        .select("id", "source", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("uses"))
        .where("uses > 0")
        .withColumn("used_tokens", F.col("tokens") * F.col("uses"))
        .withColumnRenamed("id", id_col)
    )
    used = chosen.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.count("*").alias("chosen_documents"), F.max("uses").alias("most_uses"))
    shares = (
        plan.join(used, "source", "left")
        .fillna(0, ["used_tokens", "chosen_documents", "most_uses"])
        .select("source", "target_share", "max_repeats", "documents", "available", "budget", "chosen_documents", "most_uses", "used_tokens", F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(everything)), F.lit(0.0)).alias("actual_share"))
    )
    return chosen, shares
