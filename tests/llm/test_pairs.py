"""Near copies (1), overlaps across splits (2) and leaks (6) against brute force, with the edge cases of their docstrings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.functions.text import words
from lakewarden.llm import leaks, nearcopies, overlaps

SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "vas", "per", "dor", "zi", "bel", "nor", "ul"]


def name(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(3))


def sentence(rng):
    forms = ["the {} system keeps records for {} days", "questions about {} go to the {} desk", "no {} leaves the {} site without a stamp", "during the {} drill the {} team restored all files"]
    return rng.choice(forms).format(name(rng), name(rng))


def corpus(seed, n=80):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            s = rng.choice(rows)[1].split(". ")
            how = rng.randrange(4)
            if how == 0:
                rng.shuffle(s)
            elif how == 1:
                s[0] = s[0].upper()
            elif how == 2:
                s.append(sentence(rng)) if rng.random() < 0.5 else s.pop()
            else:
                s = [x.replace("the", "this") for x in s]
            rows.append((i, ". ".join(s)))
        else:
            rows.append((i, ". ".join(sentence(rng) for _ in range(9))))
    return rows


def bag(text):
    return {(w, k) for w, n in Counter(words(text)).items() for k in range(n)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    rows = corpus(seed)
    bags = {i: bag(t) for i, t in rows}
    want = {(i, j) for i in bags for j in bags if i < j and jaccard(bags[i], bags[j]) >= 0.7}
    df = spark.createDataFrame(rows, "cid long, body string").repartition(3)
    members, pairs = nearcopies.near_copies(df, "cid", "body")
    got = {(r.a, r.b) for r in nearcopies.expanded(members, pairs).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20
    # classes are the components of the links
    label = {i: i for i in bags}
    for _ in bags:
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r["class"] for r in nearcopies.classes(members, pairs).collect()} == label


def test_near_copies_of_a_family_holding_a_third_of_the_rows(spark):
    rng = random.Random(5)
    base = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(150):
        edited = list(base)
        for k in rng.sample(range(60), 5):
            edited[k] = f"rare{rng.randrange(10**9)}"
        rows.append((i, " ".join(edited)))
    rows += [(150 + i, " ".join(f"other{rng.randrange(10**9)}" for _ in range(60))) for i in range(300)]
    bags = {i: bag(t) for i, t in rows}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if jaccard(bags[i], bags[j]) >= 0.7}
    members, pairs = nearcopies.near_copies(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {(r.a, r.b) for r in nearcopies.expanded(members, pairs).collect()}
    assert got <= want and len(got) >= 0.998 * len(want) and len(want) > 10_000


def test_near_copies_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 40, 3000):
        x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = x[: n + n // 2], x[n // 2 :]
        p, q = (nearcopies.parities(e, np.zeros(len(e), int), 1)[0] for e in (a, b))
        assert sum(int(v).bit_count() for v in (p ^ q).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_near_copies_that_meet_are_dropped_only_by_exact_bounds(spark):
    rng = random.Random(6)
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"rare{rng.randrange(10**9)}" for _ in range(60 - k)])) for i, k in enumerate([60, 58, 55, 52, 50] * 4)]
    bags = {i: bag(t) for i, t in rows}
    want = {(i, j) for i in bags for j in bags if i < j and jaccard(bags[i], bags[j]) >= 0.7}
    p = nearcopies.profiles(spark.createDataFrame(rows, "id long, text string"))
    kept = {tuple(r) for r in p.alias("x").join(p.alias("y"), F.expr(f"x.id < y.id and {nearcopies.possible('x', 'y', 0.7)}")).select("x.id", "y.id").collect()}
    assert want <= kept and len(want) > 50


def test_near_copies_pigeonhole_guarantee():
    rng = np.random.default_rng(0)
    from itertools import combinations

    kept = list(combinations(range(nearcopies.WIDTH), nearcopies.WIDTH - nearcopies.ERRORS))
    for _ in range(300):
        wrong = np.zeros(nearcopies.SYMBOLS, bool)
        wrong[rng.choice(nearcopies.SYMBOLS, nearcopies.DISTANCE, replace=False)] = True
        chunks = wrong.reshape(nearcopies.CHUNKS, nearcopies.WIDTH)
        assert any(not c[list(k)].any() for c in chunks for k in kept)


def test_near_copies_edges(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " .,! ", "x"), (4, "Same words here now", "x"), (5, "here now same WORDS", None), (5, "here now same WORDS", None), (6, long, "x"), (7, long + " extra", "x"), (None, "Same words here now", "x"), (8, "quite another text", "x")]
    df = spark.createDataFrame(rows, "id long, text string, rep string").withColumnRenamed("text", "signature")
    members, pairs = nearcopies.near_copies(df, "id", "signature")
    assert {(r.a, r.b) for r in nearcopies.expanded(members, pairs).collect()} == {(4, 5), (6, 7)}
    got = {r.id: (r["class"], r.links) for r in nearcopies.classes(members, pairs).collect()}
    assert got == {4: (4, 0), 5: (4, 0), 6: (6, 1), 7: (6, 1), 8: (8, 0)}
    members, pairs = nearcopies.near_copies(df.limit(0), "id", "signature")
    assert nearcopies.expanded(members, pairs).count() == 0 and nearcopies.classes(members, pairs).count() == 0


def test_near_copies_broadcast_nothing(spark, monkeypatch):
    """Every table of the joins grows with the records: none goes through the driver, however small Spark takes it for."""
    plans = []
    real = nearcopies.cut
    monkeypatch.setattr(nearcopies, "cut", lambda df: (plans.append(df), real(df))[1])
    df = spark.createDataFrame(corpus(7, 40), "id long, text string")
    members, pairs = nearcopies.near_copies(df, "id", "text")
    plans += [nearcopies.expanded(members, pairs), nearcopies.classes(members, pairs)]
    for p in plans[-2:]:
        p.collect()
    texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(texts) > 5 and sum("SortMergeJoin" in t for t in texts) > 3
    assert not any("Broadcast" in t for t in texts)


def test_near_copies_verify_without_moving_texts(spark):
    """Only records in a pair have their multisets made, where their texts are read: no text goes through a join."""
    df = spark.createDataFrame(corpus(9, 40), "id long, text string")
    only = nearcopies.bitmap(df.where("id in (3, 5)").select(F.xxhash64("id").alias("hash")), "hash", nearcopies.INVOLVED_BITS)
    assert sorted(r.id for r in nearcopies.multisets(df, only).collect()) == [3, 5] and nearcopies.multisets(df).count() == 40
    pairs = nearcopies.near_copies(df, "id", "text")[1]
    assert pairs.count() > 5 and "LeftSemi" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("most", "held"), [(100_000, 100_000), (100_000, 5), (4, 5), (1, 100_000)])
def test_near_copies_meet_under_keys_cut_anywhere(spark, monkeypatch, most, held):
    """Sorted once and without a join, rows of a key are paired however batches and parts cut them; keys with too many rows are named instead."""
    monkeypatch.setattr(nearcopies, "HELD", held)
    monkeypatch.setattr(nearcopies, "HOT", most)
    rows = corpus(8, 60)
    df = spark.createDataFrame(rows, "id long, text string")
    keys = nearcopies.chunk_keys(nearcopies.profiles(df).withColumn("rep", F.floor(F.col("id") / 2))).persist()
    count = Counter(r.key for r in keys.collect())
    frequent = {k for k, n in count.items() if n > most}
    assert max(count.values()) > 4
    joined = keys.alias("x").join(keys.alias("y"), F.expr(f"x.key = y.key and x.rep < y.rep and {nearcopies.possible('x', 'y', 0.7)}"))
    want = {(r.a, r.b) for r in joined.selectExpr("x.key", "x.rep a", "y.rep b").collect() if r.key not in frequent} | {(k, None) for k in frequent}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 if held == 5 else 10_000)
    try:
        met = nearcopies.meeting(keys, 0.7, most)
        got = [(r.a, r.b) for r in met.collect()]
        bags = {i: bag(t) for i, t in rows}
        pairs = {(r.a, r.b) for r in nearcopies.expanded(*nearcopies.near_copies(df, "id", "text")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        keys.unpersist()
    assert set(got) == want and len(got) == len(want) and (most == 1 or len(want) > 20)
    assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString()
    like = {(i, j) for i in bags for j in bags if i < j and jaccard(bags[i], bags[j]) >= 0.7}
    assert pairs <= like and len(pairs) >= 0.97 * len(like)


def questions(seed, n, prefix):
    rng = random.Random(seed)
    return [(f"{prefix}{i}", f"How many days may {name(rng)} staff of {name(rng)} {name(rng)} keep the {name(rng)} files when the {name(rng)} box is full under rule {rng.randrange(10000)}") for i in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_overlaps_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    train = questions(seed, 120, "t")
    held = questions(seed + 50, 10, "h")
    for i, (_, q) in enumerate(train[:40]):
        w = q.split()
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(w))
            how = rng.randrange(3)
            if how == 0:
                w[k] = name(rng)
            elif how == 1:
                w.insert(k, name(rng))
            else:
                w.pop(k)
        if i % 3 == 0:
            rng.shuffle(w)
        held.append((f"h9{i}", " ".join(w)))
    sets = lambda rows: {i: set(words(q)) for i, q in rows}
    want = {(h, t) for h, a in sets(held).items() for t, b in sets(train).items() if jaccard(a, b) >= 0.75}
    got = overlaps.overlaps(spark.createDataFrame(held, "hid string, q string"), spark.createDataFrame(train, "tid string, q string"), "hid", "tid", "q").collect()
    assert {(r.hid, r.tid) for r in got} == want and len(want) >= 20
    assert all(r.edits <= overlaps.most_edits(len(set(words(dict(held)[r.hid]))), 0.75) for r in got)


def test_overlaps_edges(spark):
    train = spark.createDataFrame([("t1", "One two three four", 1), ("t1", "One two three four", 1), ("t2", None, 2), ("t3", "", 3), ("t4", "four THREE two one", 4), (None, "one two three four", 5), ("t5", "x " * 50_000, 6)], "tid string, q string, words int")
    held = spark.createDataFrame([("h1", "one, two: three four!", 1), ("h2", None, 1), ("h3", "zzz", 1), ("h4", "x", 9)], "hid string, q string, rare int")
    got = {(r.hid, r.tid) for r in overlaps.overlaps(held, train, "hid", "tid", "q").collect()}
    assert got == {("h1", "t1"), ("h1", "t4"), ("h4", "t5")}
    assert overlaps.overlaps(held.limit(0), train, "hid", "tid", "q").count() == 0
    assert overlaps.overlaps(held, train.limit(0), "hid", "tid", "q").count() == 0


def test_segments_tile_and_leave_one_whole():
    for n in range(1, 40):
        for rare in (0, 1, n // 3, n):
            k = overlaps.most_edits(n, 0.75)
            s = overlaps.segments(np.arange(n), rare, k)
            assert len(s) == min(k + 1, n) and sum(length for _, length in s) == n and [a for a, _ in s] == list(np.cumsum([0, *[x for _, x in s]])[:-1])


def test_indel_distance():
    rng = random.Random(1)
    a, b = [], []
    for _ in range(200):
        pool = rng.sample(range(60), 40)
        a.append(np.sort(np.array(pool[: rng.randrange(1, 25)])))
        b.append(np.sort(np.array(pool[rng.randrange(0, 10) : rng.randrange(11, 40)])))
    d = overlaps.indel_distance(a, b, np.full(len(a), 80))
    assert d.tolist() == [len(set(x) ^ set(y)) for x, y in zip(a, b)]
    near = overlaps.indel_distance(a, b, np.full(len(a), 6))
    assert all((x == y) if y <= 6 else x > 6 for x, y in zip(near, d))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(2)
    a = np.array([[rng.randrange(4) for _ in range(13)] for _ in range(300)])
    b = a.copy()
    for r in range(300):
        for _ in range(rng.randrange(5)):
            b[r, rng.randrange(13)] = rng.randrange(4)
        if r % 3 == 0:
            b[r] = np.roll(b[r], 1)
    got = leaks.edit_distance(a, b, 3)
    assert got.tolist() == [min(edit(x, y), 4) for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("bits", [(24, 27), (12, 12)])
def test_leaks_exact_and_edited(spark, monkeypatch, bits):
    monkeypatch.setattr(leaks, "WORD_BITS", bits[0])  # a filter too small to hold anything back changes no row
    monkeypatch.setattr(leaks, "KEY_BITS", bits[1])
    rng = random.Random(7)
    items = [(i, " ".join(name(rng) for _ in range(30))) for i in range(40)]
    docs, exact, near = [], set(), set()
    for d in range(200):
        own = [name(rng) for _ in range(rng.randrange(5, 80))]
        if d % 2 == 0:
            i = rng.randrange(40)
            w = items[i][1].split()
            at = rng.randrange(0, 17)
            part = w[at : at + 13]
            if d % 4 == 0:
                exact.add((i, d))
            else:
                part[rng.randrange(1, 12)] = name(rng) + "q"
                near.add((i, d))
            own[3:3] = part
        docs.append((d, " ".join(own).upper() if d % 3 == 0 else ", ".join(own)))
    df, it = spark.createDataFrame(docs, "doc long, text string").repartition(4), spark.createDataFrame(items, "item long, passage string")
    got = leaks.contained(df, it, "doc", "text", "item", "passage").collect()
    assert {(r["item"], r.doc) for r in got if r.edits == 0} == exact
    found = {(r["item"], r.doc) for r in got if r.edits > 0}
    assert len(found & near) >= 0.9 * len(near)  # measured recall of one edit in a window
    # a window with one edit verifies exactly
    grams = {i: w.split() for i, w in items}
    text = {d: words(t) for d, t in docs}
    for r in got:
        assert edit(text[r.doc][r.doc_pos : r.doc_pos + 13], grams[r["item"]][r.item_pos : r.item_pos + 13]) == r.edits


@pytest.mark.parametrize("edits, least", [(1, 0.95), (2, 0.9)])
@pytest.mark.parametrize("kind", ["sub", "ins", "del"])
def test_walks_reach_their_recall(edits, least, kind):
    """At the defaults, windows within two edits share a key with the stated chance."""
    rng = np.random.default_rng(8)
    a = rng.integers(1, 2**62, (1500, 16))
    b = []
    for row in a.tolist():
        for _ in range(edits):
            p = int(rng.integers(0, 13))
            if kind == "sub":
                row[p] = int(rng.integers(1, 2**62))
            elif kind == "ins":
                row.insert(p, int(rng.integers(1, 2**62)))
            else:
                row.pop(p)
        b.append((row + [7] * 13)[:13])
    a, b = np.ascontiguousarray(a[:, :13]), np.array(b)
    plan = leaks.embedding_plan(13, leaks.WALKS, leaks.TABLES, leaks.SAMPLE, 5)
    met = (leaks.keys_of(a, plan) == leaks.keys_of(b, plan)).any(axis=1)
    near = leaks.edit_distance(a, b, 2) <= 2
    assert near.sum() > 50 and met[near].mean() >= least
    assert (leaks.keys_of(a, plan) == leaks.keys_of(a.copy(), plan)).all()


def test_leaks_without_filters_and_edges(spark, monkeypatch):
    p = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, p, 0), (1, p, 0), (2, None, 0), (3, "too short", 0), (None, p, 0)], "item long, passage string, pos int")
    docs = spark.createDataFrame([(1, "before " + p.replace(" ", "­ ") + " after", 5), (2, None, 5), (3, "", 5), (4, "x " * 300_000 + p, 5), (5, " ".join(p.split()[:12]), 5), (6, "it is far too short for that", 5), (None, p, 5)], "doc long, text string, edits int")
    want = {(1, 1), (1, 4), (3, 6)}
    run = lambda: {(r["item"], r.doc) for r in leaks.contained(docs, items, "doc", "text", "item", "passage").where("edits = 0").collect()}
    assert run() == want
    assert leaks.contained(docs.limit(0), items, "doc", "text", "item", "passage").count() == 0
    assert leaks.contained(docs.where("doc <> 4"), items.limit(0), "doc", "text", "item", "passage").count() == 0


def test_leaks_of_short_items_and_real_texts(spark, data):
    """Passages planted with one or two word edits in every thirteen into the texts of the tables: nine of ten documents are found."""
    rng = random.Random(12)
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{data}/heldout_passages.parquet").collect() if r.passage][:60]
    docs = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) between 200 and 3000").collect()][:240]
    rows, planted = [], set()
    for d, text in enumerate(docs):
        i, passage = items[d % len(items)]
        w = words(passage)
        at = rng.randrange(0, len(w) - 26)
        part = w[at : at + 26]
        for half in (0, 13):
            part[half + rng.randrange(0, 13)] = f"edit{rng.randrange(10**6)}"
        if d % 2:
            planted.add((i, d))
            text = text[:100] + " " + " ".join(part) + " " + text[100:]
        rows.append((d, text))
    found = leaks.contained(spark.createDataFrame(rows, "doc long, text string"), spark.createDataFrame(items, "item long, passage string"), "doc", "text", "item", "passage")
    assert len({(r["item"], r.doc) for r in found.collect()} & planted) >= 0.9 * len(planted)
    short = spark.createDataFrame([(1, "Four plain words here"), (2, "two words")], "item long, passage string")
    held = spark.createDataFrame([(1, "there are four plain words here, and more"), (2, "four plain words there"), (3, "Two words")], "doc long, text string")
    assert {(r["item"], r.doc, r.edits) for r in leaks.contained(held, short, "doc", "text", "item", "passage").collect()} == {(1, 1, 0), (2, 3, 0)}


def test_bitmap_holds_back_nothing_that_is_there(spark):
    from lakewarden.llm.bitmaps import among, bitmap

    rng = np.random.default_rng(3)
    there, others = rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(-(2**63), 2**63 - 1, 20000)
    b = bitmap(spark.createDataFrame([(int(x),) for x in there] + [(None,)], "key long"), "key", 20)
    assert len(b) == 2**14 and among(b, there).all() and among(b, others).mean() < 0.01
    assert not among(bitmap(spark.createDataFrame([], "key long"), "key", 12), others).any()


def test_elements_are_packed_and_compared_exactly():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 2**64, 400, dtype=np.uint64)
    b[:150] = a[:150]
    p, q = nearcopies.unpacked(nearcopies.packed(a)), nearcopies.unpacked(nearcopies.packed(b))
    assert len(nearcopies.packed(a)) == 3000 and p.tolist() == sorted((a >> np.uint64(16)).tolist())
    assert nearcopies.shared_elements(p, q) == 150 and nearcopies.shared_elements(p, p[:0]) == 0
