"""Near-duplicate records by a multi-index Hamming join.

A record is the multiset of its words. Its signature has ``SYMBOLS`` symbols of 8 bits: minimum hashes of the multiset's elements, so that two
signatures agree in a symbol with the similarity that is asked, whatever the words are and however frequent. Signatures are cut into ``CHUNKS``
chunks; by the pigeonhole principle two signatures that differ in at most ``CHUNKS * (errors + 1) - 1`` symbols agree, up to ``errors`` symbols, in
some chunk. All error patterns of each chunk are enumerated as keys (the chunk without the symbols in error), so every pair within the distance
meets under one key: rows are sorted by key once and compared in batches, those of very frequent keys in a shuffled join. A pair that meets is dropped only if its sizes or its parity sketches prove it too different; all others are verified exactly
on the word multisets.

Records with equal multisets are one representative, so a group of copies of any size enters the join once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.bitmaps import among, bitmap
from lakewarden.llm.wordcodes import Codes, codes_of
from lakewarden.runtime import cut, spread

SYMBOLS, CHUNKS, ERRORS = 50, 10, 1
WIDTH = SYMBOLS // CHUNKS
#: Guaranteed: all pairs whose signatures differ in at most so many symbols.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Bits of the parity sketch: each is the parity of the elements that fall on it, so sketches differ in no more bits than multisets in elements.
SKETCH = 256
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def stream(k: int) -> np.uint64:
    """The k-th offset of a family of hash functions."""
    return np.uint64(k * int(_MIX[0]) % 2**64)


def elements(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, code, owner): the k-th occurrence of a word within its owner is an element of its own; sorted by owner."""
    order = np.lexsort((codes, owner))
    c, o = codes[order], owner[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(c))
    k = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(c.astype(np.uint64) * _MIX[0] + k.astype(np.uint64)), c, o


def minima(element: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(owners, SYMBOLS) bytes: for each symbol the low bits of the owner's smallest hash."""
    out = np.empty((len(first), SYMBOLS), np.uint8)
    for s, offset in enumerate(stream(k + 1) for k in range(SYMBOLS)):
        out[:, s] = np.minimum.reduceat(mix(element + offset), first) & np.uint64(255)
    return out


def parities(element: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """(owners, LANES) longs: the parity sketch of each owner's elements."""
    at = owner.astype(np.int64) * SKETCH + (element % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=owners * SKETCH) & 1).astype(np.uint8).reshape(owners, SKETCH)
    return np.packbits(odd, axis=1).view(np.int64)


#: Bits of the filter of the records that are in a pair: 16 MB, however many they are.
INVOLVED_BITS = 27


def multisets(records: DataFrame, involved: np.ndarray | None = None) -> DataFrame:
    """(id, elements): the sorted hashes, ELEMENT_BYTES each, of a record's (word, occurrence) elements; only of records whose xxhash64(id) may be among ``involved``, if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Codes()
        for b in batches:
            if involved is not None:
                b = b[among(involved, b["hash"].to_numpy(np.int64))]
            rows = []
            for i, text in zip(b["id"], b["text"]):
                c = codes_of(text, memo) if text else np.zeros(0, np.int64)
                if len(c):
                    element = elements(c, np.zeros(len(c), np.int8))[0]
                    rows.append((i, packed(element)))
            yield pd.DataFrame(rows, columns=["id", "elements"])

    return records.select("id", "text", F.xxhash64("id").alias("hash")).mapInPandas(run, "id long, elements binary")


#: 48 bits: two different elements of texts of a hundred thousand words collide with a chance below one in ten thousand a pair of texts.
ELEMENT_BYTES = 6


def packed(element: np.ndarray) -> bytes:
    """Sorted elements as their high ELEMENT_BYTES bytes."""
    return np.sort(element >> np.uint64(64 - 8 * ELEMENT_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ELEMENT_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // ELEMENT_BYTES, 8), np.uint8)
    out[:, :ELEMENT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, ELEMENT_BYTES)
    return out.view("<u8").ravel()


def shared_elements(p: np.ndarray, q: np.ndarray) -> int:
    """How many elements two sorted arrays share, each as often as both have it."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    return int(same.sum()) if len(same) < 2 or not (same[1:] & same[:-1]).any() else sum((Counter(p.tolist()) & Counter(q.tolist())).values())


LANES = SKETCH // 64
SKETCHED = ["n", *[f"s{i}" for i in range(LANES)]]


def profiles(records: DataFrame) -> DataFrame:
    """(id, same, signature, n, s0, s1, ...) of (id, text) with at least one word; ``same`` identifies the word multiset, n is its size, the lanes are its sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Codes()

        def flush(ids: list, parts: list) -> pd.DataFrame:
            sizes = [len(p) for p in parts]
            element, _, owner = elements(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes))
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            signature = [x.tobytes() for x in minima(element, first)]
            same = [xxhash.xxh3_128_digest(np.sort(element[lo : lo + n]).tobytes()) for lo, n in zip(first.tolist(), sizes)]
            lanes = parities(element, owner, len(parts))
            return pd.DataFrame({"id": ids, "same": same, "signature": signature, "n": np.array(sizes, np.int32)} | {f"s{i}": lanes[:, i] for i in range(LANES)})

        for b in batches:
            ids: list = []
            parts: list = []
            size = 0
            for i, text in zip(b["id"], b["text"]):
                c = codes_of(text, memo) if text else np.zeros(0, np.int64)
                if len(c):
                    ids.append(i)
                    parts.append(c)
                    size += len(c)
                if size > 200_000:
                    yield flush(ids, parts)
                    ids, parts, size = [], [], 0
            if ids:
                yield flush(ids, parts)

    return records.mapInPandas(run, "id long, same binary, signature binary, n int, " + ", ".join(f"s{i} long" for i in range(LANES)))


def possible(x: str, y: str, similarity: float) -> str:
    """SQL that is false only where sizes or sketches prove two multisets less similar: similarity s allows (1 - s) / (1 + s) of all elements to differ."""
    bits = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(LANES))
    sizes = f"{x}.n >= {similarity} * {y}.n - 1e-9 and {y}.n >= {similarity} * {x}.n - 1e-9"
    return f"{sizes} and {bits} <= {(1 - similarity) / (1 + similarity)} * ({x}.n + {y}.n) + 1e-6"


def chunk_keys(representatives: DataFrame) -> DataFrame:
    """(rep, key, n, s0, s1, ...): for every chunk and error pattern the hash of the symbols outside the errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(17)
        factor = (rng.integers(1, 2**62, SYMBOLS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        patterns = list(combinations(range(WIDTH), WIDTH - ERRORS))
        for b in batches:
            symbols = np.frombuffer(b"".join(b["signature"]), np.uint8).reshape(len(b), SYMBOLS).astype(np.uint64) + np.uint64(1)
            products = symbols * factor
            keys = np.empty((len(b), CHUNKS * len(patterns)), np.int64)
            k = 0
            for c in range(CHUNKS):
                for p in patterns:
                    keys[:, k] = mix(products[:, [c * WIDTH + j for j in p]].sum(axis=1, dtype=np.uint64) + stream(k)).view(np.int64)
                    k += 1
            yield pd.DataFrame({"rep": np.repeat(b["rep"].to_numpy(np.int64), k), "key": keys.ravel()} | {c: np.repeat(b[c].to_numpy(), k) for c in SKETCHED})

    return representatives.select("rep", "signature", *SKETCHED).mapInPandas(run, "rep long, key long, n int, " + ", ".join(f"s{i} long" for i in range(LANES)))


#: Rows of a key up to which one task compares them; those of a key with more meet in a shuffled join, whose skewed partitions are split.
HOT = 100_000
#: Rows compared together, and pairs handed on together.
HELD = 100_000


def pairs_within(key: np.ndarray, rep: np.ndarray, n: np.ndarray, lanes: list[np.ndarray], similarity: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller reps, larger reps) of the pairs of rows with one key that ``possible`` allows; of rows sorted by key, without keys of more than ``most`` rows."""
    share = n * ((1 - similarity) / (1 + similarity)) + 5e-7
    size = np.diff(np.append(np.nonzero(np.diff(key, prepend=~key[:1]))[0], len(key)))
    end = np.repeat(np.cumsum(size), size)
    at = np.nonzero(np.repeat(size, size) <= most)[0]
    step, held, found = 0, 0, []
    while True:  # each row and the one so many steps on
        step += 1
        at = at[at + step < end[at]]
        if not len(at):
            break
        to = at + step
        bits = np.zeros(len(at), np.uint16)
        for lane in lanes:
            bits += np.bitwise_count(lane[at] ^ lane[to])
        near = np.nonzero(bits <= share[at] + share[to])[0]
        p, q = at[near], to[near]
        near = (n[p] >= similarity * n[q] - 1e-9) & (n[q] >= similarity * n[p] - 1e-9) & (rep[p] != rep[q])
        p, q = rep[p[near]], rep[q[near]]
        found.append((np.minimum(p, q), np.maximum(p, q)))
        held += len(p)
        if held > HELD:
            yield tuple(map(np.concatenate, zip(*found)))
            held, found = 0, []
    if held:
        yield tuple(map(np.concatenate, zip(*found)))


def meeting(keys: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b), a < b: reps that share a key and that ``possible`` allows, once; or (key, null) of a key with more than ``most`` rows."""
    columns = ["key", "rep", *SKETCHED]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def hot(found: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": found, "b": pd.array([None] * len(found), "Int64")})

        def compared(rows: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            key, rep, n, *lanes = rows
            values, count = np.unique(key, return_counts=True)
            if (count > most).any():
                yield hot(values[count > most])
            for a, b in pairs_within(key, rep, n, [x.view(np.uint64) for x in lanes], similarity, most):
                yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64")})

        parts: list[list[np.ndarray]] = []
        size, over = 0, None  # over: the key too frequent whose rows are passed over
        for b in batches:
            rows = [b[c].to_numpy() for c in columns]
            if over is not None:
                skip = int(np.searchsorted(rows[0], over, "right"))
                rows = [x[skip:] for x in rows]
            parts.append(rows)
            size += len(rows[0])
            if size >= HELD:
                rows = [np.concatenate(x) for x in zip(*parts)]
                last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
                if last:
                    yield from compared([x[:last] for x in rows])
                parts, size = [[x[last:] for x in rows]], size - last
                if size > most:
                    over = rows[0][-1]
                    yield hot(np.array([over]))
                    parts, size = [], 0
        if size:
            yield from compared([np.concatenate(x) for x in zip(*parts)])

    return keys.select(*columns).repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long").distinct()


def merging(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join: all tables here grow with the records, and Spark takes those that come out of Python for smaller than they are, so none may be broadcast through the driver."""
    return df.hint("merge")


def near_copies(records: DataFrame, id_col: str, text_col: str, similarity: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep; pairs: a, b, similarity), a < b representatives whose contents are similar, each link once.

    ``similarity`` is that of the word multisets (words in both over words in either, counted as often as they occur). Ids are longs. Rows
    with a null id are left out. Null, empty and wordless contents belong to no representative; repeated rows count once; an id with several contents is a member of
    several representatives. Every record's whole text counts. A pair meets in no chunk, and is lost, with a chance of 0.0005 at a similarity of 0.7
    and 0.00005 at 0.75, whatever the frequency of its words and the size of its family (a test holds a family of a third of the rows).
    """
    rows = spread(records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0"))
    base = cut(profiles(rows))
    members = base.select("id", "same").distinct()
    reps = base.groupBy("same").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("signature", *SKETCHED)])
    members = members.join(merging(reps.select("same", "rep")), "same").select("id", "rep")
    keys = chunk_keys(reps)
    met = cut(meeting(keys, similarity, HOT))
    near, hot = met.where("b is not null"), met.where("b is null").select(F.col("a").alias("key"))
    if not hot.isEmpty():
        rest = keys.join(merging(hot), "key", "left_semi")
        among = rest.alias("x").join(merging(rest.alias("y")), F.expr(f"x.key = y.key and x.rep < y.rep and {possible('x', 'y', similarity)}"))
        near = cut(near.unionByName(among.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))).distinct())
    involved = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = multisets(rows, bitmap(involved.select(F.xxhash64("id").alias("hash")), "hash", INVOLVED_BITS)).distinct()  # texts themselves are not shuffled
    left, right = (merging(sets.select(F.col("id").alias(x), F.col("elements").alias(f"e{x}"))) for x in "ab")
    both = near.join(left, "a").join(right, "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y, ea, eb in zip(b["a"], b["b"], b["ea"], b["eb"]):
                if similarity * max(len(ea), len(eb)) > min(len(ea), len(eb)):
                    continue  # too different in length to be similar
                p, q = unpacked(ea), unpacked(eb)
                shared = shared_elements(p, q)
                s = shared / (len(p) + len(q) - shared)
                if s >= similarity:
                    out.append((x, y, s))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    links = both.select("a", "b", "ea", "eb").mapInPandas(verify, "a long, b long, similarity double")
    return members, links.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def expanded(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: all linked pairs of ids, copies included."""
    m = members.select("id", "rep")
    across = pairs.join(merging(m.select(F.col("rep").alias("a"), F.col("id").alias("i"))), "a").join(merging(m.select(F.col("rep").alias("b"), F.col("id").alias("j"))), "b").select("i", "j")
    within = m.alias("x").join(merging(m.alias("y")), F.expr("x.rep = y.rep and x.id < y.id")).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    return across.unionByName(within).where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class, links): one row a record; class is the smallest id reachable over links, links the number of similar representatives.

    Smallest labels spread over links and are then followed to their own label, until nothing changes: the rounds grow as the logarithm
    of the longest chain, and no component is ever gathered in one place.
    """
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(members.select(F.col("rep").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = edges.join(merging(label), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(merging(near), F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.join(merging(step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))), F.col("label") == F.col("n2"), "left").select("node", "old", F.least("label", "l2").alias("label"))
        jump = cut(jump)
        label = jump.select("node", "label")
        if jump.where("label <> old").isEmpty():
            break
    links = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    return members.join(merging(label), F.col("rep") == F.col("node")).drop("node").join(merging(links), F.col("rep") == F.col("node"), "left").groupBy("id").agg(F.min("label").alias("class"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
