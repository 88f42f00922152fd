"""Same or nearly the same records across splits, by an edit-distance segment join over words.

A question is the sequence of its distinct words in one global order: words that are rare in the training split first, ordered by hash
within both kinds. In that order the edit distance (insertions and deletions) of two questions is the size of their symmetric difference, so
a similarity of s bounds it by ``k = n (1 - s) / s`` for a held-out question of n words, whatever was reordered. The held-out sequence is cut into
k + 1 segments (single rare words, the common words in equal runs): k edits leave one of them whole. Training sequences offer their substrings of
the lengths used; equal segments at positions at most k apart meet, an exact parity sketch discards most of them, and banded dynamic programming decides.
A training sequence of n words offers only lengths that held-out sequences of similar size use, at positions they allow; substrings that pass no
filter of held-out keys, which has a fixed size, stay at home.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.bitmaps import among, bitmap
from lakewarden.llm.wordcodes import Codes, codes_of, frequent
from lakewarden.runtime import cut, spread

#: Bits of the filter of held-out keys (8 MB, whatever the tables hold).
KEY_BITS = 26
#: Words in more than this share of the training questions are common; their number is bounded by mean words / FRACTION.
FRACTION = 0.0005


def most_edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) / similarity + 1e-9)


def segments(words: np.ndarray, rare: int, k: int) -> list[tuple[int, int]]:
    """k + 1 segments (start, length) that tile a prefix of the canonical sequence; fewer only if there are fewer words."""
    n = len(words)
    wanted = min(k + 1, n)
    single = min(rare, wanted - 1) if rare < n or rare >= wanted else wanted
    out = [(i, 1) for i in range(single)]
    rest, left = wanted - single, n - single
    size, more = divmod(left, rest) if rest else (0, 0)
    at = single
    for i in range(rest):
        length = size + (i < more)
        out.append((at, length))
        at += length
    return out


def sequences(records: DataFrame, common: dict[int, float]) -> DataFrame:
    """(id, same, words, rare, n, sketch0, sketch1) of (id, text) with at least one word."""
    shared = records.sparkSession.sparkContext.broadcast(np.array(sorted(common), np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, memo = shared.value, Codes()
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                c = np.unique(codes_of(text, memo)) if text else np.zeros(0, np.int64)
                if not len(c):
                    continue
                if len(known):
                    is_common = known[np.minimum(np.searchsorted(known, c), len(known) - 1)] == c
                else:
                    is_common = np.zeros(len(c), bool)
                c = np.concatenate([c[~is_common], c[is_common]])
                bits = np.zeros(128, np.int64)
                np.add.at(bits, c % 128, 1)
                halves = np.packbits((bits & 1).astype(np.uint8)).view(np.int64)
                rows.append((i, xxhash.xxh3_128_digest(c.tobytes()), c.tobytes(), int((~is_common).sum()), len(c), int(halves[0]), int(halves[1])))
            yield pd.DataFrame(rows, columns=["id", "same", "words", "rare", "n", "sketch0", "sketch1"])

    return records.mapInPandas(run, "id string, same binary, words binary, rare int, n int, sketch0 long, sketch1 long")


_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Keys of all substrings of ``length`` words of a sequence of codes, by one rolling polynomial hash."""
    with np.errstate(over="ignore"):
        w = words.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        w ^= w >> np.uint64(29)
        key = np.zeros(len(w) - length + 1, np.uint64)
        for j in range(length):
            key = key * _BASE + w[j : j + len(key)]
        key += np.uint64(length)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0x94D049BB133111EB)
        return (key ^ (key >> np.uint64(29))).view(np.int64)


def indel_distance(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Insertions and deletions between word sequences, pairwise, by dynamic programming in a band; above ``most`` any larger number."""
    if not a:
        return np.zeros(0, np.int32)
    band, far = int(most.max()), np.int32(1 << 20)
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x = np.full((len(a), int(n.max())), -1, np.int64)
    y = np.full((len(a), int(m.max())), -2, np.int64)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, : len(p)] = p
        y[i, : len(q)] = q
    width = y.shape[1] + 1
    out = np.full(len(a), far)
    row = np.broadcast_to(np.where(np.arange(width) <= band, np.arange(width), far), (len(a), width)).astype(np.int32)
    for i in range(x.shape[1] + 1):
        if i:
            new = np.full_like(row, far)
            lo, hi = max(0, i - band), min(width - 1, i + band)
            if lo == 0:
                new[:, 0] = i
            for j in range(max(1, lo), hi + 1):
                same = np.where(x[:, i - 1] == y[:, j - 1], row[:, j - 1], far)
                new[:, j] = np.minimum(same, np.minimum(row[:, j], new[:, j - 1]) + 1)
            row = new
        ends = n == i
        if ends.any():
            out[ends] = row[ends, m[ends]]
    return out


def overlaps(heldout: DataFrame, training: DataFrame, heldout_id: str, training_id: str, text_col: str, similarity: float = 0.75) -> DataFrame:
    """(heldout_id, training_id, similarity, edits): pairs whose questions share at least ``similarity`` of their distinct words.

    Complete for the stated similarity. Null, empty and wordless texts and null ids have no pairs; repeated rows give one row; copies within either side are
    joined once and expanded at the end; other columns are ignored, whatever their names. Ids are returned as strings.
    """
    train_rows = spread(training.select(F.col(training_id).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0"))
    held_rows = spread(heldout.select(F.col(heldout_id).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0"))
    common, _ = frequent(train_rows.select("text"), FRACTION, least=3)
    train, held = cut(sequences(train_rows, common)), cut(sequences(held_rows, common))
    one = lambda df: df.groupBy("same").agg(*[F.first(c).alias(c) for c in ("words", "rare", "n", "sketch0", "sketch1")])
    kept = ["same", "n", "sketch0", "sketch1"]

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for same, raw, rare, n, s0, s1 in zip(b["same"], b["words"], b["rare"], b["n"], b["sketch0"], b["sketch1"]):
                w = np.frombuffer(raw, np.int64)
                k = most_edits(n, similarity)
                rows += [(same, n, s0, s1, k, start, length, int(rolling(w[start : start + length], length)[0])) for start, length in segments(w, rare, k)]
            yield pd.DataFrame(rows, columns=[*kept, "k", "start", "length", "key"])

    held_cuts = cut(one(held).mapInPandas(cuts, "same binary, n int, sketch0 long, sketch1 long, k int, start int, length int, key long"))
    # one row a size of held-out questions and length of their segments: how far into a sequence they reach; sizes are small integers
    sizes = held_cuts.groupBy("n", "length").agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.max("k").alias("k")).collect()
    uses = sorted((r.length, r.n, r.lo - r.k, r.hi + r.k) for r in sizes)
    sc = train.sparkSession.sparkContext
    wanted_b, uses_b = sc.broadcast(bitmap(held_cuts, "key", KEY_BITS)), sc.broadcast(uses)

    def substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, uses, memo = wanted_b.value, uses_b.value, {}
        for b in batches:
            size = b["n"].to_numpy(np.int64)
            words = np.frombuffer(b"".join(b["words"]), np.int64)
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(words)) - first[row]
            out_row, out_start, out_key = [], [], []
            for length in sorted({u[0] for u in uses}):
                if length > len(words):
                    continue
                lo, hi = np.full(len(size), 1 << 30), np.full(len(size), -1)
                for n in np.unique(size).tolist():
                    if (length, n) not in memo:
                        fit = [u for u in uses if u[0] == length and n >= similarity * u[1] - 1e-9 and u[1] >= similarity * n - 1e-9]
                        memo[length, n] = (max(0, min(u[2] for u in fit)), min(n - length, max(u[3] for u in fit))) if fit else (0, -1)
                    lo[size == n], hi[size == n] = memo[length, n]
                at = np.nonzero((place >= lo[row]) & (place <= hi[row]))[0]
                if len(at):
                    key = rolling(words, length)[np.minimum(at, len(words) - length)]
                    hit = among(wanted, key)
                    out_row.append(row[at[hit]])
                    out_start.append(place[at[hit]])
                    out_key.append(key[hit])
            if out_row:
                picked = b.iloc[np.concatenate(out_row)]
                yield pd.DataFrame({c: picked[c].to_numpy() for c in kept} | {"start": np.concatenate(out_start).astype(np.int32), "key": np.concatenate(out_key)})

    train_parts = one(train).mapInPandas(substrings, "same binary, n int, sketch0 long, sketch1 long, start int, key long")
    met = (
        held_cuts.alias("h")
        .join(train_parts.alias("t"), F.expr(f"h.key = t.key and abs(h.start - t.start) <= h.k and t.n >= {similarity} * h.n - 1e-9 and h.n >= {similarity} * t.n - 1e-9 and bit_count(h.sketch0 ^ t.sketch0) + bit_count(h.sketch1 ^ t.sketch1) <= h.k"))
        .select(F.col("h.same").alias("hs"), F.col("t.same").alias("ts"))
        .distinct()
        .join(one(held).select(F.col("same").alias("hs"), F.col("words").alias("hw")), "hs")
        .join(one(train).select(F.col("same").alias("ts"), F.col("words").alias("tw")), "ts")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, t = [np.frombuffer(x, np.int64) for x in b["hw"]], [np.frombuffer(x, np.int64) for x in b["tw"]]
            n, m = np.array([len(x) for x in h], int), np.array([len(x) for x in t], int)
            k = np.array([most_edits(x, similarity) for x in n], int)
            d = indel_distance(h, t, k)
            both = (n + m - d) / 2
            s = both / np.maximum(n + m - both, 1)
            good = (d <= k) & (s >= similarity)
            yield pd.DataFrame({"hs": b["hs"][good], "ts": b["ts"][good], "similarity": s[good], "edits": d[good].astype("int32")})

    pairs = met.mapInPandas(verify, "hs binary, ts binary, similarity double, edits int")
    return (
        pairs.join(held.select(F.col("same").alias("hs"), F.col("id").alias(heldout_id)).distinct(), "hs")
        .join(train.select(F.col("same").alias("ts"), F.col("id").alias(training_id)).distinct(), "ts")
        .groupBy(heldout_id, training_id)
        .agg(F.max("similarity").alias("similarity"), F.min("edits").alias("edits"))
    )
