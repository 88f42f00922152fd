"""Retrieval: exact nearest neighbours, BM25, rank fusion, dedupe, budgets, and the measures of a ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions import text as tx
from lakewarden.functions import vectors as vx

#: Most bytes of vectors in one block of queries and in one batch of items.
QUERY_BLOCK_BYTES, ITEM_BATCH_BYTES = 16 << 20, 8 << 20


def _packed(rows: DataFrame, width: int, most: int, kind: str, prefix: str) -> DataFrame:
    """(ids, vectors): rows (i, v) packed into blocks of at most ``most`` bytes of unit vectors; zero vectors are left out."""
    count = max(1, most // (8 * width))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        parts: list[np.ndarray] = []

        def block() -> pd.DataFrame:
            return pd.DataFrame({f"{prefix}_ids": [ids], f"{prefix}_vectors": [np.concatenate(parts).tobytes()]})

        for b in batches:
            if not len(b):
                continue
            x = np.array(b["v"].tolist(), float)
            length = np.linalg.norm(x, axis=1)
            own = b["i"].tolist()
            keep = np.nonzero(length > 0)[0]
            for lo in range(0, len(keep), count):
                at = keep[lo : lo + count]
                if ids and len(ids) + len(at) > count:
                    yield block()
                    ids, parts = [], []
                ids += [own[j] for j in at]
                parts.append(x[at] / length[at, None])
        if ids:
            yield block()

    return rows.mapInPandas(pack, f"{prefix}_ids array<{kind}>, {prefix}_vectors binary")


def nearest(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, query_vec: str = "embedding", item_vec: str = "embedding", with_self: bool = True) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of highest cosine for each query, exact.

    Queries and items are packed into blocks of a bounded size on the executors; every block of queries meets every batch of items, one matrix product
    each, keeps k a query, and the partial lists merge in a window, so only k rows a query and batch are shuffled and no vector passes the
    driver. Ties go to the smaller item id. Null and zero vectors, and those of another length than most, match nothing.
    """
    q = queries.select(F.col(query_id).alias("i"), vx.doubles(F.col(query_vec)).alias("v")).where("v is not null and size(v) > 0")
    width = (q.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count")).first() or [0])[0]
    q_kind, i_kind = dict(queries.dtypes)[query_id], dict(items.dtypes)[item_id]
    schema = f"{query_id} {q_kind}, {item_id} {i_kind}, score double"
    if not width:
        return q.sparkSession.createDataFrame([], schema + ", rank int")
    blocks = _packed(q.where(F.size("v") == width), width, QUERY_BLOCK_BYTES, q_kind, "q")
    rows = items.select(F.col(item_id).alias("i"), vx.doubles(F.col(item_vec)).alias("v")).where(F.size("v") == width)
    batches_ = _packed(rows, width, ITEM_BATCH_BYTES, i_kind, "i")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, raw, own, vectors in zip(b["q_ids"], b["q_vectors"], b["i_ids"], b["i_vectors"]):
                m, x = np.frombuffer(raw).reshape(-1, width), np.frombuffer(vectors).reshape(-1, width)
                item, out = list(own), []
                top = min(len(item), k + 1)
                for lo in range(0, len(m), 256):
                    s = m[lo : lo + 256] @ x.T
                    edge = np.partition(s, -top, axis=1)[:, -top]
                    for row, qid in enumerate(ids[lo : lo + 256]):
                        close = [(-float(s[row, j]), item[j]) for j in np.nonzero(s[row] >= edge[row])[0] if with_self or item[j] != qid]
                        out += [(qid, i, -d) for d, i in sorted(close)[:k]]
                yield pd.DataFrame(out, columns=[query_id, item_id, "score"])

    found = batches_.crossJoin(blocks).mapInPandas(score, schema)  # a row a batch and block of megabytes, not a row a pair
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), item_id))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf, length): the keyword index, one row a document and term."""
    t = docs.select(F.col(doc_id), tx.tokens(F.col(text)).alias("ts")).withColumn("length", F.size("ts"))
    return t.select(doc_id, "length", F.explode("ts").alias("term")).groupBy(doc_id, "length", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: str, doc_id: str, doc_text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25-Okapi over lower-case blank-separated tokens; statistics of ``docs`` as given.

    A negative idf is replaced by ``epsilon`` times the mean idf. Query terms count as often as they occur. Only documents sharing a term are scored; the
    rest have score 0 and are left out, as are queries nothing matches. Ties go to the smaller id.
    """
    own = docs.select(F.col(doc_id), tx.tokens(F.col(doc_text)).alias("ts")).withColumn("length", F.size("ts"))
    stats = own.agg(F.count("*").cast("double").alias("docs"), F.avg("length").alias("mean_length"))
    # document frequencies combine a term on the map side: what is shuffled is the vocabulary, not the postings
    df = own.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df")).crossJoin(stats)  # stats is one row
    idf = df.withColumn("raw", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    idf = idf.crossJoin(mean).select("term", "mean_length", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select(F.col(query_id), F.explode(tx.tokens(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    # only occurrences of asked terms become postings
    wanted = asked.select("term").distinct()
    post = own.select(doc_id, "length", F.explode("ts").alias("term")).join(wanted, "term", "left_semi").groupBy(doc_id, "length", "term").agg(F.count("*").alias("tf"))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.col("mean_length")))
    scored = asked.join(idf, "term").join(post, "term").groupBy(query_id, doc_id).agg(F.sum(F.col("qtf") * gain).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), doc_id))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def fused(dense: DataFrame, keyword: DataFrame, query_id: str, content: str, k: int, constant: int = 60) -> DataFrame:
    """(query_id, content, score, rank): reciprocal-rank fusion of two ranked lists (with ``rank`` from 1) keyed by the content itself.

    A content that occurs twice in a list adds twice. Ties keep first insertion order: dense before keyword, then rank.
    """
    both = dense.select(query_id, content, "rank", F.lit(0).alias("list")).unionByName(keyword.select(query_id, content, "rank", F.lit(1).alias("list")))
    gain = F.lit(1.0).cast("double") / (F.lit(constant) + F.col("rank")).cast("double")
    merged = both.groupBy(query_id, content).agg(F.sum(gain).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), "first.list", "first.rank", content)
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, content, F.round("score", 6).alias("score"), "rank")


def dedupe_first(df: DataFrame, group: list[str], position: str, keys: list[str]) -> DataFrame:
    """The first row of each key within a group, in position order; the key is the first non-empty one of ``keys``."""
    key = F.coalesce(*[F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in keys])
    at = Window.partitionBy(*group, key).orderBy(position)
    return df.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")


def budget_prefix(df: DataFrame, group: list[str], order: list, size: Column, budget: float, most: int) -> DataFrame:
    """The longest prefix of each group within a number of items and a running size; the first item always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("position") <= most) & ((F.col("position") == 1) | (F.col("running") <= budget)))


def labelled(df: DataFrame, group: list[str], order: list, text: str, budget_chars: int = 7000) -> DataFrame:
    """Evidence labels E1, E2, ... of non-blank texts whose running length stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept = df.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("__run", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where(F.col("__run") <= budget_chars).drop("__run").withColumn("label", F.concat(F.lit("E"), F.row_number().over(w)))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query_id: str, item_id: str, depth: int = 10) -> DataFrame:
    """One row: queries, recall@1, recall@5, mrr@depth and misses@5, over the first relevant hit of each query with any relevant item."""
    asked = relevant.select(query_id).distinct()
    hits = ranked.join(relevant.select(query_id, item_id).distinct(), [query_id, item_id], "left_semi").groupBy(query_id).agg(F.min("rank").alias("hit"))
    per = asked.join(hits, query_id, "left")
    within = lambda n: F.coalesce(F.col("hit") <= n, F.lit(False))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(within(1).cast("int")), 6).alias("recall_at_1"), F.round(F.avg(within(5).cast("int")), 6).alias("recall_at_5"), F.round(F.avg(F.when(within(depth), F.lit(1.0) / F.col("hit")).otherwise(0.0)), 6).alias("mrr"), F.count_if(~within(5)).alias("misses_at_5"))


def moved(df: DataFrame, group: list[str], before: str, after: str) -> DataFrame:
    """(group..., top_moved, from_rank): whether reranking changed the first place, and where the new first came from."""
    w = Window.partitionBy(*group)
    first = df.withColumn("__b", F.row_number().over(w.orderBy(F.desc(before)))).withColumn("__a", F.row_number().over(w.orderBy(F.desc(after))))
    return first.where("__a = 1").select(*group, (F.col("__b") != 1).alias("top_moved"), F.col("__b").alias("from_rank"))
