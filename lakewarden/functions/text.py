"""Text normalisation shared by the operators.

A *word* is a run of letters or digits after removing invisible characters (soft hyphens, zero-width), compatibility
normalisation (NFKC) and lower-casing.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Soft hyphen, combining grapheme joiner, Mongolian separator, zero-width and direction marks, word joiners, byte-order mark.
INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]")
WORD = re.compile(r"[^\W_]+")
JAVA_WORD = r"[\p{L}\p{N}]+"


def fold(text: str) -> str:
    """Invisible characters removed, NFKC, lower case."""
    if text.isascii():
        return text.lower()
    text = INVISIBLE.sub("", text)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Column form of :func:`fold`; there is no built-in for NFKC. Null stays null."""
    return text.map(fold, na_action="ignore")


def word_array(text: Column) -> Column:
    """Words of a text, in order, as ``array<string>``; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(JAVA_WORD), F.lit(0)), F.array().cast("array<string>"))


# --------------------------------------------------------------------------------------------------------------------- words and numbers
#: Words that carry no content (fixed values).
STOP_WORDS = (
    "the a an of to in and or is are was were for on that with as by it this be from at their its can has have"
).split()
#: Where sentences end, what a number is and what negates (fixed values, on which results depend).
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"
NUMBER = r"\d[\d,]*\.?\d*"
NEGATION = r"(?i)\b(?:not|no|never|cannot|without|neither|nor)\b|n't"

#: Evidence labels in brackets, as an answer cites them.
CITED = r"\[\s*(E\d+(?:[\s,]+E\d+)*)\s*\]"


def tokens(text: Column) -> Column:
    """Lower-case, blank-separated tokens; none for null and blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def terms(text: Column, shortest: int = 1, letters_only: bool = False) -> Column:
    """Distinct content words: ASCII letters and digits (or letters), stop words and words below ``shortest`` left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+" if letters_only else "[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) >= shortest)))


def numbers(text: Column) -> Column:
    """Distinct numbers as written, without thousands separators and a closing point."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(",")), r"\.$", "")))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.trim(s) != "")


def negations(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NEGATION))


def overlap(a: Column, b: Column) -> Column:
    """Share of the elements of ``a`` that are in ``b``; 0 for an empty ``a``."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def contained(a: Column, b: Column) -> Column:
    """Whether every element of ``a`` is in ``b``."""
    return F.size(F.array_except(a, b)) == 0


#: A number with an optional currency sign (fixed value).
_NUM = r"\$?(\d[\d,]*\.?\d*)"
#: Ways to state a span of numbers (fixed values): kind -> pattern; group 1 (and 2) are its ends.
RANGES = {
    "between": r"(?i)(?<![\d.\-/])" + _NUM + r"\s*%?\s*(?:to|through|-|–|—)\s*" + _NUM + r"(?![\d\-/])",
    "or_more": r"(?i)" + _NUM + r"\s*%?\s*(?:or more|or above|or higher|or over|and above|and over|\+)",
    "above": r"(?i)\b(?:above|over|more than|at least|exceeds?|minimum of|greater than)\s+" + _NUM,
    "below": r"(?i)\b(?:below|under|less than|fewer than|up to|at most|maximum of|no more than)\s+" + _NUM,
}
OPEN_END_FACTOR, OPEN_END_LEAST = 5.0, 10.0


def _value(n: Column) -> Column:
    return F.regexp_replace(F.replace(n, F.lit(",")), r"\.$", "").try_cast("double")


def ranges(text: Column) -> Column:
    """array<struct<lo, hi>> of the number spans a text states; an open end reaches to five times the bound, at least ten above."""
    t = F.coalesce(text, F.lit(""))

    def ends(kind: str, group: int = 1) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(RANGES[kind]), F.lit(group)), _value)

    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    upward = lambda lo: span(lo, F.greatest(lo * OPEN_END_FACTOR, lo + OPEN_END_LEAST))
    return F.concat(
        F.filter(F.zip_with(ends("between", 1), ends("between", 2), span), lambda r: r["lo"] < r["hi"]),
        F.transform(ends("or_more"), upward),
        F.transform(ends("above"), upward),
        F.transform(ends("below"), lambda hi: span(F.lit(0.0), hi)),
    )


def in_ranges(number: Column, spans: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda r: number.try_cast("double").between(r["lo"], r["hi"])), F.lit(False))


# --------------------------------------------------------------------------------------------------------------------- disguises
#: Cyrillic and Greek letters that look like Latin ones, and those (fixed values).
LOOK_ALIKES = "авекмнорстухѕіјԁԛԝүһАВЕКМНОРСТУХЅІЈαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "abekmhopctyxsijdqwyhABEKMHOPCTYXSIJaeikvoptuxABEZHIKMNOPTYX"


def fold_look_alikes(text: Column) -> Column:
    """Look-alike letters to Latin: all of them if no other foreign letter occurs, else only in words that mix scripts."""
    foreign = r"[\p{L}&&[^a-zA-Z" + LOOK_ALIKES + "]]"
    mixed = F.transform(F.split(text, r"(?U)(?<=\w)(?!\w)|(?<!\w)(?=\w)"), lambda w: F.when(w.rlike("[a-zA-Z]"), F.translate(w, LOOK_ALIKES, LATIN)).otherwise(w))
    return F.when(~text.rlike("[" + LOOK_ALIKES + "]"), text).when(text.rlike(foreign), F.array_join(mixed, "")).otherwise(F.translate(text, LOOK_ALIKES, LATIN))


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC; there is no built-in for it."""
    return text.map(lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s), na_action="ignore")


def for_scan(text: Column) -> Column:
    """What a pattern scanner reads: NFKC, no control and format characters but line breaks and tabs, look-alikes folded."""
    return fold_look_alikes(F.regexp_replace(compatible(F.coalesce(text, F.lit(""))), r"[\p{C}&&[^\n\r\t]]", ""))


def slug(name: Column) -> Column:
    """A file name as an identifier: no folder, no extension, lower case, runs of other characters as one dash."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def network(address: Column) -> Column:
    """The /24 of an IPv4 address (also one mapped into IPv6), the /64 of an IPv6 address, anything else unchanged."""
    plain = F.regexp_replace(F.lower(F.trim(address)), r"^::ffff:(?=\d+\.)", "")
    left = F.split(F.element_at(F.split(plain, "::"), 1), ":")
    right = F.filter(F.split(F.try_element_at(F.split(plain, "::"), F.lit(2)), ":"), lambda x: x != "")
    left = F.filter(left, lambda x: x != "")
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(F.coalesce(right, F.array().cast("array<string>")))))
    full = F.concat(left, gap, F.coalesce(right, F.array().cast("array<string>")))
    hextets = F.array_join(F.transform(F.slice(full, 1, 4), lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")
    return F.when(plain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.concat(F.regexp_extract(plain, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24"))).when(plain.rlike(r"^[0-9a-f:]+$") & plain.contains(":"), F.concat(hextets, F.lit("::/64"))).otherwise(address)


def duration(ms: Column) -> Column:
    """Milliseconds for reading: 950 ms, 12.3 s, 4.5 min."""
    return F.when(ms.isNull(), F.lit("-")).when(ms < 1000, F.format_string("%.0f ms", ms)).when(ms < 60000, F.format_string("%.1f s", ms / 1000)).otherwise(F.format_string("%.1f min", ms / 60000))


#: A few function words a language (fixed values).
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "for", "with"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "für"],
    "fr": ["le", "la", "les", "et", "des", "est", "pour", "que"],
    "es": ["el", "los", "las", "de", "que", "para", "una", "del"],
}


def language(text: Column) -> Column:
    """The language with most of its function words among the tokens; null if none has any, ties in the order above."""
    own = F.array_distinct(tokens(text))
    score = [F.struct(F.size(F.array_intersect(own, F.array(*map(F.lit, w)))).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, w) in enumerate(LANGUAGE_WORDS.items())]
    best = F.greatest(*score)
    return F.when(best["n"] > 0, best["k"])
