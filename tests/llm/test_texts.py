"""Percentiles (3), scanned text (4), personal information (5), mixing (7) and splitting (8), with the edge cases of their docstrings."""

import math
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import mixing, percentiles, pii, scans, splitting, tokens


# -------------------------------------------------------------------------------------------------------------------- 3
def nearest_rank(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(q * len(v) - 1e-9)) - 1]


@pytest.mark.parametrize("error", [0.01, 0.05, None])
def test_percentiles_within_the_stated_error(spark, error):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", math.exp(rng.gauss(3, 2))) for i in range(5000)] + [("a", 7.0)] * 500 + [("c", 1e-9), (None, 5.0)]
    rows += [("a", None), ("a", float("nan")), ("a", -1.0), ("a", 0.0), ("a", float("inf")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in percentiles.percentiles(percentiles.summary(df, ["g"], "v", error), ["g"], [0.5, 0.9, 0.999], error).collect()}
    good = {}
    for g, v in rows:
        if v is not None and 0 < v < float("inf"):
            good.setdefault(g, []).append(v)
    assert set(got) == set(good)
    for g, v in good.items():
        assert got[g].n == len(v)
        for q, name in ((0.5, "p50"), (0.9, "p90"), (0.999, "p99_9")):
            exact = nearest_rank(v, q)
            assert abs(got[g][name] - exact) <= (error or 0) * exact * (1 + 1e-9)


def test_percentiles_combine(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"day{i % 9}", rng.expovariate(0.01) + 0.1) for i in range(3000)], "day string, v double")
    whole = percentiles.percentiles(percentiles.summary(df, [], "v"), [], [0.5, 0.95]).first()
    days = percentiles.summary(df, ["day"], "v")
    parts = percentiles.merged(days.where("day < 'day5'").unionByName(days.where("day >= 'day5'")), [])
    assert percentiles.percentiles(parts, [], [0.5, 0.95]).first() == whole


def test_percentiles_of_negative_values_and_empty_tables(spark):
    df = spark.createDataFrame([(float(x),) for x in (-100, -2.5, 0, 0.001, 3, 3, 50)], "v double")
    s = percentiles.summary(df, [], "v", None, lowest=-1e9)
    assert percentiles.percentiles(s, [], [0.1, 0.5, 0.9], None).first()[1:] == (-100.0, 0.001, 50.0)
    assert percentiles.percentiles(percentiles.summary(df.limit(0), [], "v"), [], [0.5]).where("n is not null").count() == 0


# -------------------------------------------------------------------------------------------------------------------- 4
BASE = ["the committee must keep every record for thirty days", "questions about travel go to the service desk", "no document leaves the building without a number", "the gateway stops and mailboxes stay unread", "part-time staff may carry over leave", "management expects the average between both"]


def model_rows(n=400):
    rng = random.Random(3)
    return [(i, ". ".join(rng.choice(BASE).capitalize() for _ in range(5)) + ".") for i in range(n)]


NOISY = {
    1001: "The cornmittee must keep every rec0rd for thirty days. Questions about\ntravel go to the scrvice desk.",
    1002: "The committee must keep every record for thirty days. Ques-\ntions about travel go to the service desk. No document leaves the buil­\nding without a number.",
    1003: "The gateway stops and mailboxes stay\nRecords Handbook | Norvale\nPage 3 of 9\nunread. Management expects the average between both.",
}
CLEAN = {
    2001: "The committee must keep every record\nfor thirty days. Questions about travel go\nto the service desk.",
    2002: "Records Handbook\n\nThe gateway stops and mailboxes stay unread.",
    2003: "- the gateway stops\n- mailboxes stay unread\n1. no document leaves\n2. questions about travel",
    2004: "The comimttee must keep every recrod for thirrty days.",
    2005: "All part-\ntime staff may carry over leave.",
    2006: "| a | b |\n| --- | --- |\n| 1 | 2 |",
}


def test_scans_found_and_repaired(spark):
    rows = model_rows() + list(NOISY.items()) + list(CLEAN.items())
    extra = [(3001, None), (3002, ""), (3003, "x" * 200_000), (3004, "word " * 60_000), (None, NOISY[1001]), (1001, NOISY[1001])]
    df = spark.createDataFrame(rows + extra, "id long, text string").withColumn("joined", F.lit("clash"))
    got = {r.id: r for r in scans.repaired(df, "id", "text").collect()}
    assert set(got) == set(NOISY)
    assert got[1001].text == "The committee must keep every record for thirty days. Questions about travel go to the service desk." and got[1001].corrected == 3
    assert got[1002].text == "The committee must keep every record for thirty days. Questions about travel go to the service desk. No document leaves the building without a number." and got[1002].joined == 2
    assert got[1003].text == "The gateway stops and mailboxes stay unread. Management expects the average between both." and got[1003].removed == 2
    assert scans.repaired(df.limit(0), "id", "text").count() == 0


def test_viterbi_uses_the_context():
    m = scans.Model(words={w: math.log(p) for w, p in {"the": 0.2, "modern": 0.01, "modem": 0.01, "is": 0.1, "times": 0.05}.items()}, pairs={("modern", "times"): math.log(0.9), ("modem", "is"): math.log(0.9)})
    m.doubtful = {"modern": [("modern", 0.0), ("modem", math.log(0.004))]}
    s = scans.Speller(m)
    assert scans.decode(["the", "modern", "times"], s)[1] == "modern" and scans.decode(["the", "modern", "is"], s)[1] in ("modern", "modem")


# -------------------------------------------------------------------------------------------------------------------- 5
PII = [
    (1, "Contact: marek70@desk.invalid / 01632 960673 for details.", {"email", "phone"}),
    (2, "Interview with Carmen Pelkakost, held on 17 March 2024.", {"person_name"}),
    (3, "Identity was checked against SSN 813753782.", {"id_number"}),
    (4, "Send the parcel to Calle del Pozo 59, 4.º B, 00468 Aldersund.", {"street_address"}),
    (5, "Please write to henrik.zelvukaholm at post dot test about it.", {"email"}),
    (6, "Cache key user@69 has no owner. Ticket 3945-69-4392 was merged. Street lighting on site was replaced.", set()),
    (7, "The answer service reads 254 passages from the Kelsiral gateway before it may export anything.", set()),
]


def test_personal_information(spark):
    filler = "The answer service reads 25 passages from the archive. " * 400
    rows = [(i, t, "x") for i, t, _ in PII] + [(8, filler + "Caller left the number +1 770 555 0193, nothing else. " + filler, "x"), (9, None, "x"), (10, "", "x"), (None, PII[0][1], "x"), (1, PII[0][1], "x")]
    df = spark.createDataFrame(rows, "rid long, body string, spans string")
    got = {r.rid: r for r in pii.personal(df, "rid", "body").collect()}
    for i, text, kinds in PII:
        assert {s.kind for s in got[i].spans} == kinds if kinds else i not in got, i
    assert got[1].text == "Contact: [EMAIL] / [PHONE] for details."
    assert got[2].text == "Interview with [PERSON_NAME], held on 17 March 2024."
    s = got[8].spans[0]
    assert (filler + "Caller left the number +1 770 555 0193, nothing else. " + filler)[s.start : s.end] == "+1 770 555 0193" and got[8].text == filler + "Caller left the number [PHONE], nothing else. " + filler
    assert 9 not in got and 10 not in got
    assert pii.personal(df.limit(0), "rid", "body").count() == 0


def test_windows_do_not_change_the_decision():
    t = pii.Tagger()
    alone = t.tag(["Contact: marek70@desk.invalid / 01632 960673 for details."])[0]
    for n in (40, 50, 60, 70):
        before = "Kopien bei Wennovar werden nach 48 Monaten abgeglichen. " * n
        shifted = t.tag([before + "Contact: marek70@desk.invalid / 01632 960673 for details."])[0]
        assert [(a - len(before), b - len(before), k) for a, b, k in shifted] == alone


def test_accuracy_on_forms_in_no_list():
    """On composed texts whose names, streets and numbers stand in no list of the grammars, in sentences of their own."""
    from tests.llm.pii_blind import blind, measured

    t = pii.Tagger()
    texts = blind(1, 500)
    found = [pii.bordered(x, s) for (x, _), s in zip(texts, t.tag([x for x, _ in texts]))]
    got = measured(found, [s for _, s in texts])
    for kind in pii.KINDS:
        recall, precision, there = got[kind]
        assert there > 80
        least = 0.7 if kind == "person_name" else 0.9
        assert recall >= least and precision >= least, (kind, recall, precision)


def test_the_network_decides():
    """With other weights the rows change: the same forms are found in one context and not in another."""
    t = pii.Tagger()
    text = "Call Mrs Lindqvist on +44 20 7946 0958. Invoice 20-4471-8820-1 was paid in Green Bay."
    assert [k for *_, k in t.tag([text])[0]] == ["person_name", "phone"]
    t.bias = t.bias + np.array([50.0] + [0.0] * len(pii.KINDS), np.float32)
    assert t.tag([text]) == [[]]


def test_batched_decoding_is_viterbi():
    """Decoding in groups, with the runs that cannot win left out, gives the best path of each text on its own."""
    from itertools import product

    t = pii.Tagger()
    rng = np.random.default_rng(2)
    many = [rng.normal(0, 4, (int(rng.integers(1, 5)), 6)).astype(np.float32) + np.array([4, 0, 0, 0, 0, 0], np.float32) for _ in range(60)]
    for e, tags in zip(many, t.decode(many)):
        cost = lambda p: t.start[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(t.trans[x, y] for x, y in zip(p, p[1:]))
        assert cost(tuple(tags)) >= max(map(cost, product(range(6), repeat=len(e)))) - 1e-3


def test_stretches_hold_every_composed_span():
    """What the network is not shown cannot be found: nearly every composed span lies in a stretch."""
    from lakewarden.llm import pii_forms

    forms, there, held = pii_forms.Forms(np.random.default_rng(5)), 0, 0
    for _ in range(1500):
        text, spans = pii_forms.composed(forms, list(pii.KINDS))
        parts = pii.stretches(text)
        there += len(spans)
        held += sum(any(a <= lo and hi <= b for a, b in parts) for lo, hi, _ in spans)
    assert held >= 0.99 * there
    texts = ["", "a", "Mr Smith", "\n\n", "nothing here"]
    together = pii.parts_of(texts)[1]
    assert together == [(k, lo, hi) for k, t in enumerate(texts) for lo, hi in pii.stretches(t)]


def test_whole_texts_are_read():
    """No rule decides what the network is shown: an address beside no capital and no known street word is found, and windows cover every position."""
    t = pii.Tagger()
    text = "Wir wohnen jetzt in der 105 place Bellecour."
    assert [(text[lo:hi], k) for lo, hi, k in pii.bordered(text, t.tag([text])[0])] == [("105 place Bellecour", "street_address")]
    texts = ["nothing to be seen here. " * 60, "", "One plain Sentence without any cue.", "x"]
    assert [pii.stretches(x) for x in texts] == [[(0, len(x))] if x else [] for x in texts]
    shown = []
    scores = t.scores
    t.scores = lambda windows: (shown.extend(map(len, windows)), scores(windows))[1]
    t.tag(texts)
    assert sum(shown) == sum(max(len(x), 0) + pii.OVERLAP * max(0, -(-(len(x) - pii.WINDOW) // (pii.WINDOW - pii.OVERLAP))) for x in texts)


def test_no_state_is_computed_that_no_score_needs():
    """Where windows overlap, neither direction goes on into the half that the other window scores; the scores used are those of whole windows."""
    t = pii.Tagger()
    texts = ["Please ask Margaret Whitaker, 14 Baker Street, or call 020 7946 0958. " * n for n in (1, 4, 9, 30)]
    read, used, run, decode = [], [], t._run, t.decode
    t._run = lambda symbols, d: (read.append((d, int((symbols > 0).sum()))), run(symbols, d))[1]
    t.decode = lambda emissions: (used.extend(emissions), decode(emissions))[1]
    t.tag(texts)
    overlaps = sum(max(0, -(-(len(x) - pii.WINDOW) // (pii.WINDOW - pii.OVERLAP))) for x in texts)
    for d in "fb":
        assert sum(n for way, n in read if way == d) == sum(map(len, texts)) + pii.OVERLAP // 2 * overlaps
    for text, e in zip(texts, used):
        x = pii.parts_of([text])[0]
        for at in range(0, max(1, len(x) - pii.OVERLAP), pii.WINDOW - pii.OVERLAP):
            whole = t.scores([x[at : at + pii.WINDOW]])[0]
            lo, hi = pii.OVERLAP // 2 if at else 0, len(whole) - (pii.OVERLAP // 2 if at + pii.WINDOW < len(x) else 0)
            np.testing.assert_allclose(e[at + lo : at + hi], whole[lo:hi], atol=1e-4)


def test_decoding_leaves_out_only_what_cannot_win():
    """Long sequences with few tags: the same as a full Viterbi pass, at borders and within."""
    t = pii.Tagger()
    rng = np.random.default_rng(4)
    many = [(rng.normal(0, scale, (int(rng.integers(1, 80)), 6)) + np.array([lead, 0, 0, 0, 0, 0])).astype(np.float32) for scale in (2, 4, 6) for lead in (2, 5, 9) for _ in range(60)]
    many.append(np.zeros((0, 6), np.float32))
    tagged = 0
    for e, tags in zip(many[:-1], t.decode(many)):
        score, back = t.start + e[0], []
        for x in e[1:]:
            step = score[:, None] + t.trans
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + x
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert tags.tolist() == path[::-1]
        tagged += int((tags > 0).sum())
    assert tagged > 1000


def test_training_learns_a_little(tmp_path, monkeypatch):
    from lakewarden.llm import pii_train

    monkeypatch.setattr(pii_train, "COMPOSED", 400)
    monkeypatch.setattr(pii_train, "WORKERS", 2)
    rng = random.Random(4)
    texts = [f"{rng.choice(BASE).capitalize()}. Call 01632 96{rng.randrange(1000, 9999)} now. {rng.choice(BASE)}." if i % 2 else f"{rng.choice(BASE)} {i}." for i in range(400)]
    said = []
    pii_train.train(texts, str(tmp_path / "w.npz"), epochs=6, report=said.append)
    losses = [float(x.split("loss ")[1].split(",")[0]) for x in said if "loss" in x]
    assert losses[-1] < 0.5 * losses[0] and pii.Tagger(str(tmp_path / "w.npz")).hidden == pii_train.HIDDEN


def test_crf_gradient():
    import numpy as np

    from lakewarden.llm import pii_train

    rng = np.random.default_rng(0)
    em, tags, mask = rng.standard_normal((5, 2, 6)), rng.integers(0, 6, (5, 2)), np.ones((5, 2))
    mask[3:, 1] = 0
    trans, start = rng.standard_normal((6, 6)), rng.standard_normal(6)
    _, dem, dtrans, dstart = pii_train.crf(em, tags, mask, trans, start)
    for x, d, at in ((em, dem, (1, 0, 2)), (trans, dtrans, (0, 3)), (start, dstart, (4,))):
        old = x[at]
        x[at] = old + 1e-5
        up = pii_train.crf(em, tags, mask, trans, start)[0]
        x[at] = old - 1e-5
        down = pii_train.crf(em, tags, mask, trans, start)[0]
        x[at] = old
        assert d[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# -------------------------------------------------------------------------------------------------------------------- 7
def test_mixture(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(5, 60))), "big" if i < 600 else "mid" if i < 800 else "small") for i in range(820)]
    rows += [(9001, None, "big"), (9002, "", "big"), (9003, "text", None), (9004, "text", "untargeted"), (None, "text", "big"), (0, rows[0][1], "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("key", F.lit(1))
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.0, 1), (None, None, None)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(docs, goal)
    c, s = chosen.collect(), {r.source: r for r in shares.collect()}
    assert len({r.doc_id for r in c}) == len(c) and all(r.doc_id is not None and r.doc_id < 820 for r in c)
    most = {"big": 1, "mid": 2, "small": 3}
    count = {i: len(tokens.encoder().encode_ordinary(t)) for i, t, _ in rows if i is not None and t}
    for r in c:
        assert r.tokens == count[r.doc_id] and 1 <= r.uses <= most[r.source] and r.used_tokens == r.uses * r.tokens
    for k, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert s[k].actual_share == pytest.approx(want, abs=0.01)
        assert abs(s[k].used_tokens - s[k].budget) <= 30  # half of the largest document
    again = sorted(map(tuple, mixing.mixture(docs.repartition(7), goal)[0].collect()))
    assert again == sorted(map(tuple, c))
    big = {r.source: r for r in mixing.mixture(docs, goal, total_tokens=10**9)[1].collect()}
    assert big["small"].most_uses == 3 and big["small"].chosen_documents == 20 and big["big"].actual_share > big["small"].actual_share
    chosen, shares = mixing.mixture(docs.limit(0), goal)
    assert chosen.count() == 0 and shares.where("used_tokens > 0").count() == 0
    assert mixing.mixture(docs, goal.limit(0))[0].count() == 0


# -------------------------------------------------------------------------------------------------------------------- 8
def handbook(rng, sections=12):
    return "\n\n".join(f"## Part {k}\n\n" + "\n\n".join(" ".join(f"Sentence {j} of part {k} names {rng.randrange(1000)}." for j in range(rng.randrange(2, 9))) for _ in range(3)) for k in range(sections))


def test_pieces_tile_fit_and_overlap(spark):
    rng = random.Random(6)
    texts = [handbook(rng), "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | cell {i * 7} |" for i in range(400)), "word " * 3000, "x" * 9000, "漢字" * 1500, "short", None, "", "\n" * 4000 + "end " * 900]
    docs = spark.createDataFrame([(i, t, "k" if i != 5 else "other") for i, t in enumerate(texts)] + [(None, texts[0], "k"), (0, texts[0], "k")], "doc_id long, text string, doc_type string").withColumn("tokens", F.lit("clash"))
    limits = spark.createDataFrame([("k", 300, 30), ("none", 1, 0)], "doc_type string, max_tokens int, overlap_tokens int")
    encode = tokens.encoder().encode_ordinary
    big = {i for i, t in enumerate(texts) if t and i != 5 and len(encode(t)) > 300}
    assert {r.doc_id for r in splitting.oversized(docs, limits).collect()} == big
    got = {}
    for r in splitting.pieces(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), limits).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == big
    for i, parts in got.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.pieces == len(parts) for r in parts)
        assert parts[0].body_start == 0 and parts[-1].end == len(texts[i]) and all(a.end == b.body_start for a, b in zip(parts, parts[1:]))
        for a, r in zip([None, *parts], parts):
            assert r.text == texts[i][r.start : r.end] and r.tokens == len(encode(r.text)) <= 300
            if a is not None and i in (0, 1, 2):
                shared = len(encode(texts[i][r.start : r.body_start]))
                assert 30 <= shared + 2 and shared <= 45 and r.start < r.body_start
    assert sum(r.boundary.startswith("heading") for r in got[0][1:]) >= 1 and {r.boundary for r in got[1][1:]} == {"line"} and {r.boundary for r in got[2][1:]} == {"word"}
    assert splitting.pieces(docs.limit(0), limits).count() == 0 and splitting.oversized(docs, limits.limit(0)).count() == 0


def pieces_of(text, limit, overlap=0):
    import regex

    return [(text[a:b], name) for a, _, b, name in splitting.split_text(text, limit, overlap, tokens.encoder().encode_ordinary, regex.compile(tokens.PATTERN))]


def test_no_piece_reaches_from_within_one_section_into_the_next():
    paragraph = lambda s, k: f"Paragraph {s}.{k} " + " ".join(f"says that item {j} is kept." for j in range(8))
    text = "\n\n".join(f"# Section {s}\n\n" + "\n\n".join(paragraph(s, k) for k in range(n)) for s, n in ((1, 3), (2, 1), (3, 3), (4, 1), (5, 1)))
    got = pieces_of(text, 160)
    assert "".join(t for t, _ in got) == text
    whole = {s: text[text.index(f"# Section {s}") : text.index(f"# Section {s + 1}") if s < 5 else len(text)] for s in range(1, 6)}
    for t, _ in got:
        inside = [s for s in whole if f"Paragraph {s}." in t]
        assert len(inside) == 1 or all(whole[s] in t for s in inside), t
        assert all(t.count(f"# Section {s}") == 0 or f"Paragraph {s}.0" in t for s in whole)  # a heading stays with its text
    assert any("# Section 4" in t and "# Section 5" in t for t, _ in got)


def test_lists_markup_and_fences():
    items = "".join(f"- item {i} of the list\n" + "".join(f"  - detail {i}.{j} with a few more words\n" for j in range(3)) for i in range(6))
    got = pieces_of(items, 90)
    assert "".join(t for t, _ in got) == items and all(t.startswith("- item") for t, _ in got) and {n for _, n in got[1:]} == {"item 0"}
    fence = "```\n# no heading\nx = 1\n\n# none either\n```"
    assert [n for n, _ in splitting.levels_of("# One\n\nText.\n\n" + fence)] == ["heading 1", "block", "line", "sentence"]
    assert len(dict(splitting.levels_of("# One\n\nText.\n\n" + fence))["heading 1"]) == 1
    html = "<div>" + "".join(f"<section><h2>Part {i}</h2><p>{'some words here ' * 9}</p><p>{'other words there ' * 9}</p></section>" for i in range(4)) + "</div>"
    got = pieces_of(html, 120)
    assert "".join(t for t, _ in got) == html and all(t.startswith("<h2>Part") or "<section>" in t[:20] for t, _ in got)


def test_the_first_piece_uses_the_whole_limit():
    text = "Some plain words stand here. " * 60
    a, b = pieces_of(text, 160, 60)[:2]
    encode = tokens.encoder().encode_ordinary
    assert len(encode(a[0])) > 140 and len(encode(b[0])) <= 100
