"""Building evaluation sets: seeded splits, hidden and divided attacks, template products, exclusion of leaked texts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions import text as tx
from lakewarden.operators import ranks


def seeded(*parts: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from a hash of the given values."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**53)).cast("double") / F.lit(float(2**53))


def split(df: DataFrame, id_col: str, shares: dict[str, float], seed: int = 0, stratum: list[str] | None = None) -> DataFrame:
    """Rows with a ``split``, cut at the shares of a seeded order; exact a stratum (its rows are counted, not sampled)."""
    w = Window.partitionBy(*(stratum or [F.lit(1)]))
    if not stratum:  # one global order would be one task: a uniform hash cuts within a row of the exact place
        place = seeded(F.col(id_col), seed=seed)
    else:
        place = (F.row_number().over(w.orderBy(seeded(F.col(id_col), seed=seed), id_col)) - 1) / F.count("*").over(w)
    name, upto = F.lit(None).cast("string"), 0.0
    cases = []
    for k, share in shares.items():
        upto += share
        cases.append((place < upto - 1e-12, k))
    for cond, k in reversed(cases):
        name = F.when(cond, F.lit(k)).otherwise(name)
    return df.withColumn("split", F.coalesce(name, F.lit(list(shares)[-1])))


def stratified(df: DataFrame, id_col: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows a stratum, by seeded order."""
    w = Window.partitionBy(stratum).orderBy(seeded(F.col(id_col), seed=seed), id_col)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def excluded(df: DataFrame, text: str, held: DataFrame, held_text: str) -> DataFrame:
    """Rows whose text, as words, does not occur among the held texts."""
    key = lambda c: F.array_join(tx.word_array(c), " ")
    return df.withColumn("__key", key(F.col(text))).join(held.select(key(F.col(held_text)).alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def hidden(attacks: DataFrame, carriers: DataFrame, attack_id: str, attack: str, carrier: str, seed: int = 0) -> DataFrame:
    """(attack_id, position, text, label): each attack hidden at the start, middle and end of a carrier's sentences, and the bare carrier as benign twin.

    Attacks and carriers are paired by their rank in seeded order, modulo the number of carriers.
    """
    c = carriers.select(F.col(carrier).alias("c")).where("c is not null").distinct()
    ranked = ranks.numbered(c.withColumn("__h", seeded(F.col("c"), seed=seed)), [], ["__h", "c"]).select("c", F.col("__n").alias("slot"))
    total = c.agg(F.count("*").alias("total"))
    a = attacks.crossJoin(total).withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), attack_id), F.greatest("total", F.lit(1))))
    j = a.join(ranked, "slot").withColumn("s", tx.sentences(F.col("c"))).withColumn("half", F.floor(F.size("s") / 2).cast("int"))
    place = F.explode(F.array(F.lit("start"), F.lit("middle"), F.lit("end"), F.lit("none"))).alias("position")
    r = j.select(attack_id, attack, "c", "s", "half", place)
    middle = F.concat_ws(" ", F.array_join(F.slice("s", F.lit(1), F.col("half")), " "), F.col(attack), F.array_join(F.slice("s", F.col("half") + 1, F.size("s")), " "))
    body = F.when(F.col("position") == "start", F.concat_ws(" ", attack, "c")).when(F.col("position") == "middle", F.trim(middle)).when(F.col("position") == "end", F.concat_ws(" ", "c", attack)).otherwise(F.col("c"))
    return r.select(attack_id, "position", body.alias("text"), F.when(F.col("position") == "none", "benign").otherwise("attack").alias("label"))


def divided(attacks: DataFrame, attack_id: str, attack: str, filler: str) -> DataFrame:
    """(attack_id, text): the words of an attack in two halves with a sentence between them."""
    w = tx.tokens(F.col(attack))
    half = F.ceil(F.size(w) / 2).cast("int")
    return attacks.select(attack_id, F.concat_ws(" ", F.array_join(F.slice(w, F.lit(1), half), " "), F.lit(filler), F.array_join(F.slice(w, half + 1, F.greatest(F.size(w) - half, F.lit(0))), " ")).alias("text"))


def templates(parts: dict[str, list[str]], pattern: str, session) -> DataFrame:
    """The product of short literal lists, formatted: one row a combination, with its parts."""
    df = None
    for name, values in parts.items():
        one = session.createDataFrame([(v,) for v in values], f"{name} string")
        df = one if df is None else df.crossJoin(one)  # literal lists of a few words each
    return df.withColumn("text", F.format_string(pattern, *[F.col(k) for k in parts]))


def manifest(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys..., rows, by_label: map<label, count>) from counts; a missing label counts as "unknown"."""
    c = df.groupBy(*keys, F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("l")).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(F.sum("n").alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n")))).alias("by_label"))  # a label each
