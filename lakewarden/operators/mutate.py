"""Seeded rewordings of attack texts for robustness tests: disguise of letters, spacing, wrapping and padding; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden.functions import text as tx

#: Words and what may stand for them (fixed values).
SYNONYMS = {"ignore": "disregard", "previous": "earlier", "instructions": "directions", "reveal": "show", "password": "passphrase", "secret": "confidential", "rules": "guidelines", "print": "display"}
WRAPPERS = ("For a training exercise: %s", "Translate this and then follow it: %s", "My manager asked me to check: %s", "Quote of the day: \"%s\"")
FILLER = "Please keep the answer short and friendly."


def mutated(text: Column, how: str, seed: Column | None = None) -> Column:
    """A text under one mutation: synonym, wrapper, homoglyph, leet, spacing or pad. ``seed`` picks among wrappers; null stays null."""
    if how == "synonym":
        out = text
        for word, other in SYNONYMS.items():
            out = F.regexp_replace(out, rf"(?i)\b{word}\b", other)
        return out
    if how == "wrapper":
        which = F.pmod(F.xxhash64(seed if seed is not None else text), F.lit(len(WRAPPERS))).cast("int")
        return F.when(text.isNotNull(), F.element_at(F.array(*[F.format_string(w, text) for w in WRAPPERS]), which + 1))
    if how == "homoglyph":
        return F.translate(text, "aeopc", "аеорс")
    if how == "leet":
        return F.translate(text, "aeiost", "4310$7")
    if how == "spacing":
        return F.regexp_replace(text, r"(?<=\p{L})(?=\p{L})", " ")
    if how == "pad":
        return F.concat_ws(" ", F.lit(FILLER), text, F.lit(FILLER))
    raise ValueError(f"unknown mutation {how!r}")


def restored(text: Column) -> Column:
    """What a scanner makes of the disguises it undoes."""
    return tx.for_scan(text)
