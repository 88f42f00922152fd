"""Evaluation passages inside a large corpus.

Passages and documents are read as word sequences. Every window of ``run`` words (of all words, for a shorter item) is walked by a CGK embedding: position i of the
window is repeated or left according to random bits of the word itself, which maps edit distance to Hamming distance. Repeated bit sampling
of the embedding gives the LSH keys; windows that agree in one key are joined and verified by exact banded edit distance.

Two lossless filters of a fixed size keep the corpus side small: a window with more than ``max_edits`` words that occur in no item cannot be within
``max_edits`` of an item window; a key that no item has cannot join. Windows meet in one shuffled join whatever the number of items: keys travel without
words, each pair of windows that met is kept once, and equal item windows take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import words
from lakewarden.llm.bitmaps import among, bitmap
from lakewarden.llm.wordcodes import Codes
from lakewarden.runtime import cut, spread

#: Bits of the filters of item words and item keys (2 and 16 MB, whatever the tables hold).
WORD_BITS, KEY_BITS = 24, 27
#: Independent walks, sampling tables a walk, and sampled positions a table.
WALKS, TABLES, SAMPLE = 4, 3, 5
#: Windows embedded at once.
BLOCK = 100_000


def embedding_plan(run: int, walks: int, tables: int, sample: int, seed: int) -> list[tuple[np.int64, list[list[tuple[int, np.int64]]]]]:
    """For each walk its random bits (a multiplier), and for each of its steps which tables sample it and with what multiplier."""
    rng = np.random.default_rng(seed)
    odd = lambda: np.int64(rng.integers(1, 2**62) * 2 + 1)
    out = []
    for w in range(walks):
        steps: list[list[tuple[int, np.int64]]] = [[] for _ in range(2 * run)]  # later steps are mostly padding
        for t in range(w * tables, (w + 1) * tables):
            for j in rng.choice(2 * run, size=min(sample, 2 * run), replace=False):
                steps[j].append((t, odd()))
        out.append((odd(), steps))
    return out


def keys_of(windows: np.ndarray, plan: list) -> np.ndarray:
    """LSH keys, (n, walks * tables), of windows of word codes, (n, run)."""
    n, run = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), -1, np.int64)], axis=1).ravel()
    base = np.arange(n) * (run + 1)
    tables = 1 + max(t for _, steps in plan for s in steps for t, _ in s)
    keys = np.zeros((tables, n), np.int64)
    with np.errstate(over="ignore"):
        for bits, steps in plan:
            random = padded * bits
            random ^= random >> 31
            at = base.copy()
            end = base + run
            for j, samples in enumerate(steps):
                if samples:
                    symbol = padded[at]
                    symbol ^= symbol >> 29
                    for t, factor in samples:
                        keys[t] += symbol * factor
                at += (random[at] >> (j % 31)) & 1
                np.minimum(at, end, out=at)
        keys ^= (keys >> 31) & 0xFFFFFFFF
        keys += np.arange(tables, dtype=np.int64)[:, None]
    return keys.T


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of rows of two (n, run) arrays, exact up to ``most``, by dynamic programming within the band; else most + 1."""
    n, run = a.shape
    far = np.int16(most + 1)
    previous = np.full((n, run + 1), far, np.int16)
    previous[:, : most + 1] = np.arange(most + 1, dtype=np.int16)
    for i in range(1, run + 1):
        row = np.full((n, run + 1), far, np.int16)
        if i <= most:
            row[:, 0] = i
        for j in range(max(1, i - most), min(run, i + most) + 1):
            best = previous[:, j - 1] + (a[:, i - 1] != b[:, j - 1])
            best = np.minimum(best, np.minimum(previous[:, j], row[:, j - 1]) + 1)
            row[:, j] = np.minimum(best, far)
        previous = row
    return previous[:, run]


def windows_of(df: DataFrame, shapes: list[tuple[int, int, list]], known: np.ndarray | None = None, keys: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """(id, pos, keys, words) of every window of the shapes (words, edits, plan) that passes the filters; df is (id, text).

    Keys are those that pass their filter, and a window without any is left out. With ``whole`` (items) a text has windows of the largest shape it fills.
    """
    sc = df.sparkSession.sparkContext
    known_b, keys_b = sc.broadcast(known), sc.broadcast(keys)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, keys, codes = known_b.value, keys_b.value, Codes()

        def flush(shape: int, ids: list, at: list, views: list) -> pd.DataFrame:
            run, _, plan = shapes[shape]
            w = np.concatenate(views)
            k = keys_of(w, plan) + np.int64(run)
            i, pos = np.concatenate(ids), np.concatenate(at)
            hit = np.ones(k.shape, bool) if keys is None else among(keys, k)
            kept = np.nonzero(hit.any(axis=1))[0]
            return pd.DataFrame({"id": i[kept], "pos": pos[kept], "keys": pd.Series([x[h].tolist() for x, h in zip(k[kept], hit[kept])], dtype=object), "words": pd.Series([x.tobytes() for x in w[kept]], dtype=object)})

        held: dict[int, tuple[list, list, list]] = {}
        size = dict.fromkeys(range(len(shapes)), 0)
        for batch in batches:
            for i, text in zip(batch["id"], batch["text"]):
                w = words(text)
                if not w:
                    continue
                c = np.fromiter(map(codes.__getitem__, w), np.int64, len(w))
                fitting = [x for x in range(len(shapes)) if shapes[x][0] <= len(c)]
                for shape in fitting[-1:] if whole else fitting:
                    run, edits, _ = shapes[shape]
                    for lo in range(0, len(c) - run + 1, BLOCK):
                        part = c[lo : lo + BLOCK + run - 1]
                        view = np.lib.stride_tricks.sliding_window_view(part, run)
                        where = np.arange(len(view))
                        if known is not None:
                            strange = np.concatenate([[0], np.cumsum(~among(known, part))])
                            where = np.nonzero(strange[run:] - strange[:-run] <= edits)[0]
                        if len(where):
                            ids, at, views = held.setdefault(shape, ([], [], []))
                            ids.append(np.full(len(where), i))
                            at.append(where + lo)
                            views.append(view[where])
                            size[shape] += len(where)
                        if size[shape] >= BLOCK:
                            yield flush(shape, *held.pop(shape))
                            size[shape] = 0
        for shape in list(held):
            yield flush(shape, *held.pop(shape))

    return df.mapInPandas(emit, "id long, pos long, keys array<long>, words binary")


def contained(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, run: int = 13, max_edits: int = 2, walks: int = WALKS, tables: int = TABLES, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """(item_id, doc_id, doc_pos, item_pos, edits): windows of ``run`` words of a document within ``max_edits`` word edits of one of an item.

    An item of fewer words is one window of all of them, with edits in proportion. Windows that agree exactly always meet (equal windows have equal embeddings);
    with edits the chance grows with ``walks`` and ``tables`` and falls with ``sample`` (a test measures it at the defaults). Rows with a null id are left out;
    null and empty texts have no window. Repeated rows give one result row; whole texts of any length are read. Ids are longs; other columns are
    ignored, whatever their names.
    """
    item_rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    shapes = [(n, n * max_edits // run, embedding_plan(n, walks, tables, min(sample, 2 * n), seed)) for n in range(1, run + 1)]

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": sorted({min(len(words(t)), run) for t in b["text"]})})

    used = {r.n for r in item_rows.mapInPandas(lengths, "n int").distinct().collect()}  # at most ``run`` of them
    shapes = [s for s in shapes if s[0] in used]
    item_windows = cut(windows_of(item_rows, shapes, whole=True).select(F.col("id").alias(item_id), F.col("pos").alias("item_pos"), "keys", "words"))

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"code": np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(w, np.int64) for w in b["words"])]))})

    # numbers given before the checkpoint stay: they stand for windows wherever words are not needed
    one = cut(item_windows.groupBy("words").agg(F.first("keys").alias("keys")).withColumn("window", F.monotonically_increasing_id()))
    known = bitmap(one.select("words").mapInPandas(codes, "code long"), "code", WORD_BITS)
    item_keys = one.select(F.explode("keys").alias("key"), "window")
    keys = bitmap(item_keys, "key", KEY_BITS)
    doc_rows = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null"))
    doc_windows = cut(windows_of(doc_rows, shapes, known, keys).select(F.col("id").alias("d"), F.col("pos").alias("dp"), "keys", F.col("words").alias("dw"), F.monotonically_increasing_id().alias("row")))
    # a hot key (a passage in a third of the corpus) has many windows on this side and one a distinct item window on the other: a skewed
    # partition is split by the adaptive join
    met = doc_windows.select("row", F.explode("keys").alias("key")).join(item_keys, "key").select("row", "window").distinct()
    pairs = met.join(doc_windows.drop("keys"), "row").drop("row").join(one.select("window", F.col("words").alias("iw")), "window").where("octet_length(iw) = octet_length(dw)")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allowed = {n: e for n, e, _ in shapes}
        for b in batches:
            for n, part in b.groupby(b["iw"].str.len() // 8):
                read = lambda c: np.frombuffer(b"".join(part[c]), np.int64).reshape(len(part), n)  # noqa: E731, B023
                edits = edit_distance(read("dw"), read("iw"), allowed[n])
                good = edits <= allowed[n]
                yield pd.DataFrame({"d": part["d"][good], "dp": part["dp"][good], "window": part["window"][good], "edits": edits[good].astype("int32")})

    found = pairs.select("d", "dp", "dw", "window", "iw").mapInPandas(verify, "d long, dp long, window long, edits int")
    where = item_windows.join(one.select("words", "window"), "words").select(item_id, "item_pos", "window").distinct()
    return found.join(where, "window").select(item_id, F.col("d").alias(doc_id), F.col("dp").alias("doc_pos"), "item_pos", "edits").groupBy(item_id, doc_id, "doc_pos", "item_pos").agg(F.min("edits").alias("edits"))
