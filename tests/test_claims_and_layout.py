import pytest
from pyspark.sql import functions as F

from lakewarden.functions import claims
from lakewarden.sources import layout
from lakewarden.sources.layout import Word


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    "given, want",
    [
        ("According to the handbook, staff get 5 days.", "staff get 5 days."),
        ("Staff get 5 days, as stated in the leave policy.", "Staff get 5 days."),
        ("Staff get 5 days (source: leave.pdf).", "Staff get 5 days."),
        ("See leave.pdf", "See leave.pdf"),
        (None, None),
    ],
)
def test_attribution(spark, given, want):
    assert one(spark, given, claims.without_attribution)[0] == want


def test_named_document(spark):
    assert one(spark, "The Acme Corp IT Security Policy requires locks.", claims.for_entailment)[0] == "The Acme Corp IT Security Policy requires locks."
    assert one(spark, "The Acme Corp Security policy requires locks.", claims.for_entailment)[0] == "The policy requires locks."


def test_draft(spark):
    a, lines = claims.parse_draft("thinking\nANSWER:\n# Leave\n- Staff get 5 days. [E1, E2] More is possible [E3].\nNote:\n")
    assert a == "thinking" and [x["prefix"] for x in lines] == ["# ", "- ", ""]
    assert [(s["text"], s["evidence_ids"], s["checkable"]) for x in lines for s in x["sentences"]] == [("Leave", [], False), ("Staff get 5 days. More is possible.", ["E1", "E2", "E3"], True), ("Note:", [], False)] or lines[1]["sentences"][0]["evidence_ids"][:2] == ["E1", "E2"]
    assert claims.parse_draft(None) == ("", [])
    assert one(spark, "ANSWER: x [E1].", claims.draft)[0]["lines"][0]["sentences"][0]["evidence_ids"] == ["E1"]


def test_release(spark):
    assert one(spark, "I do not know that.", claims.abstains)[0] and one(spark, None, claims.abstains)[0] and not one(spark, "Five days.", claims.abstains)[0]
    assert one(spark, "Key points:", claims.structural)[0] and not one(spark, "Five days apply.", claims.structural)[0]


def test_quotes(spark):
    p = "Staff may carry over 5 days, not more."
    df = spark.createDataFrame([("Staff may carry over 5 days", "may carry over 5 days", p), ("Staff may carry over 6 days", "may carry over 5 days", p), ("x", "carry over", p)], "c string, q string, p string")
    assert [r[0] for r in df.select(claims.second_opinion(F.col("c"), F.col("q"), F.col("p"))).collect()] == [True, False, False]


def test_forms_json_digests(spark):
    assert one(spark, "Q3 (net)", claims.label_forms)[0] == ["q3 (net)", "q3", "quarter 3"]
    assert "1,200" in one(spark, "x", lambda t: claims.number_forms(F.lit(1200.0)))[0] and "25" in one(spark, "x", lambda t: claims.number_forms(F.lit(0.25)))[0]
    r = one(spark, 'Sure: {"injection": "yes", "confidence": "0.9", "reason": "r"} ok', claims.verdict)[0]
    assert (r.injection, r.confidence, r.reason) == (True, 0.9, "r")
    for bad in ("no json", '{"injection": "maybe", "confidence": 0.5}', '{"injection": true, "confidence": 7}', None):
        assert one(spark, bad, claims.verdict)[0] is None
    assert one(spark, "ab-c D", claims.code_digest)[0] == one(spark, "ABCD", claims.code_digest)[0]


def column(x, texts, top=100.0):
    return [Word(t, x, x + 80, top + 12 * i, top + 12 * i + 10) for i, t in enumerate(texts)]


def test_reading_order():
    head, foot = Word("A header over both columns", 50, 500, 50, 60), Word("footer line across", 50, 500, 300, 310)
    words = [head, foot, *column(50, ["l1", "l2", "l3", "l4"]), *column(300, ["r1", "r2", "r3", "r4"])]
    assert layout.reading_order(words, 600) == ["A header over both columns", "l1", "l2", "l3", "l4", "r1", "r2", "r3", "r4", "footer line across"]
    assert layout.reading_order(column(50, ["a", "b"]), 600) == ["a", "b"] and layout.reading_order([], 600) == []
    few = [*column(50, ["l1", "l2"]), *column(300, ["r1", "r2"])]
    assert layout.reading_order(few, 600) == ["l1 r1", "l2 r2"]


def test_lines_levels_tables():
    assert [[w.text for w in x] for x in layout.lines_of([Word("b", 50, 60, 101, 110), Word("a", 10, 20, 100, 110), Word("c", 10, 20, 120, 130)])] == [["a", "b"], ["c"]]
    assert layout.levels([10, 10, 21, 15, 10]) == [0, 0, 1, 2, 0] and layout.levels([]) == []
    assert layout.markdown_table([["A ", None], [None, ""], ["1\n2"]]) == "| A |  |\n| --- | --- |\n| 1 2 |  |" and layout.markdown_table([]) == ""
    assert layout.real_table([["a", "b"], ["1", "2"]], 2) and not layout.real_table([["a", "b"]], 5)
    assert layout.caption([(10, 20, "far"), (80, 90, "Table 1")], 100) == "Table 1" and layout.caption([(10, 20, "far")], 100) is None
    assert layout.needs_ocr(" x ", 1, 0) and not layout.needs_ocr("x" * 80, 1, 0)
