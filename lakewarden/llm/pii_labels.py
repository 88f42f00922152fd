"""Weak labels of real texts for training the personal-information tagger; nothing at run time uses them.

Shapes label mail addresses, telephone and identity numbers and street addresses. Names are labelled where a title, an initial or a common given
name stands before a family name; two capitalised words that are neither that nor made of common words or nouns of places and units are *unsure*: a
window with one is left out of the training.
"""

from __future__ import annotations

import re
import unicodedata

from lakewarden.llm import pii_forms
from lakewarden.llm.pii import JOINING, KINDS

_bare = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
#: Given names known to the labeller.
GIVEN = frozenset(_bare(x) for names in pii_forms.GIVEN.values() for x in names)
NOUNS = frozenset(x.lower() for x in [*pii_forms.PLACES_AFTER, *pii_forms.UNITS_AFTER, *pii_forms.PLACES_BEFORE, *pii_forms.ORGANISED, *(x for v in pii_forms.UNITS_BEFORE.values() for x in v), *(w for cues in pii_forms.CUES.values() for v in cues.values() for c in v for w in re.findall(r"[^\W\d_]+", c))]) | JOINING
_AT = r"(?:\s*[\[({]\s*(?:at|arroba|ät)\s*[\])}]\s*)"
_DOT = r"(?:\s*[\[({]\s*(?:dot|punto|point|punkt)\s*[\])}]\s*|\s+(?:dot|punto|point|punkt)\s+)"
_LOCAL = r"[^\W_](?:[\w.+%'-]{0,62}[^\W_])?"
EMAIL = re.compile(
    rf"{_LOCAL}@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+|{_LOCAL}{_AT}[^\W_][\w-]*(?:(?:\.|{_DOT})[^\W_][\w-]*)+|{_LOCAL}\s+(?:at|arroba)\s+[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.,/-])(?:tel:\s?)?(?:\+\d{1,3}|00\d{2})[\s.-]?(?:\(0\)[\s.-]?)?\(?\d{1,5}\)?(?:[\s.-]?\d{2,8}){1,5}(?:\s?(?:ext|x)\.?\s?\d{1,5})?(?![\w-]|[.,]\d)"
    r"|(?<![\w.,/-])(?:1[-. ])?\(?\d{3}\)?[-. ]\s?\d{3}[-. ]\d{4}(?:\s?(?:ext|x)\.?\s?\d{1,5})?(?![\w-]|[.,]\d)"
    r"|(?<![\w.,/-])\(0\d{1,4}\)\s?\d{2,8}(?:[- ]\d{2,6}){0,3}(?![\w-]|[.,]\d)"
    r"|(?<![\w.,/-])0\d{3,4}[ -]\d{3}[ -]?\d{3,4}(?![\w-]|[.,]\d)|(?<![\w.,/-])0\d(?:[ .-]\d{2}){4}(?![\w-]|[.,]\d)",
    re.I,
)
#: Serial and ticket numbers that look like telephone numbers.
SERIAL = re.compile(r"\d{4}(?: \d{4}){2,}|\d{4}-\d{2}-\d{4}")
ID_NUMBER = re.compile(
    r"(?<![\w./-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{8}[A-Z]|\d{2}-\d{4}-\d{3}-[A-Z]|[A-Z]\d{8}|[A-Z]{2}\d{7}|\d{2}/\d{3}/\d{5}|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?)(?![\w/-]|[.,]\d)"
    r"|(?:(?<=SSN )|(?<=SSN: )|(?<=number )|(?<=ID )|(?<=Nr\. )|(?<=no\. ))\d{9,11}(?![\w/-])",
    re.I,
)
_TYPE = r"(?:street|st|road|rd|lane|close|court|drive|avenue|ave|blvd|boulevard|terrace|row|way|square|place|crescent)"
STREET = re.compile(
    rf"(?<![\w,.-])\d{{1,4}}[a-z]?\s(?P<street>(?:(?!(?:am|pm|days?|of)\b)[^\W\d_]+\s){{1,3}})(?P<type>{_TYPE})\b(?!-)"
    r"|\b(?:calle|avenida|plaza|paseo)\s(?:(?:del|de\sla|de\slos|de\slas|de)\s)?[^\W\d_]+\s\d{1,4}\b"
    r"|(?<![\w.-])\d{1,4}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|allée|impasse|chemin|quai)\s(?:(?:du|de\sla|des|de)\s)?[^\W\d_]+"
    r"|\b[^\W\d_]{1,40}(?:straße|strasse|weg|gasse|platz|allee)\s\d{1,4}[a-z]?\b",
    re.I,
)
_TITLE = r"(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|sr|sra)"
_FAMILY = r"(?:[od]['’])?[^\W\d_]{3,}(?:-[^\W\d_]{3,})?"
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_PAIR = re.compile(rf"(?<![\w@.])(?P<first>{_WORD})(?P<mark>\.?)(?:\s+(?P<middle>[^\W\d_])\.)?\s+(?P<family>{_WORD})(?![\w@])")
_TITLED = re.compile(rf"(?<![\w@.])(?P<title>{_TITLE})(?:\.\s+|\s+)(?P<family>{_FAMILY})(?![\w@])", re.I)
_REVERSED = re.compile(rf"(?<![\w@.])(?P<family>{_FAMILY}),\s+(?P<first>{_WORD})(?!\w)(?:\s+[^\W\d_]\.(?!\w))?")


def digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def shaped(kind: str, text: str) -> list[tuple[int, int]]:
    """Spans that have the shape of a kind, names aside."""
    if kind == "email":
        return [m.span() for m in EMAIL.finditer(text)] if "@" in text or re.search(r"\b(?:at|arroba|ät)\b", text, re.I) else []
    if kind == "phone":
        return [m.span() for m in PHONE.finditer(text) if 9 <= digits(m.group()) <= 18 and not SERIAL.match(m.group())]
    if kind == "id_number":
        return [m.span() for m in ID_NUMBER.finditer(text)]
    found = []
    cased = not (text.isupper() or text.islower())
    for m in STREET.finditer(text):
        if cased and m["street"] and not (m["street"][0].isupper() and m["type"][0].isupper()):
            continue  # "4 answers from one place"
        found.append(m.span())
    return found


def names(text: str, common: frozenset[str] | set[str], given: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(name spans, unsure spans). Letter case counts where the text mixes it."""
    cased = not (text.isupper() or text.islower())
    found, unsure = [], []

    def capital(word: str) -> bool:
        return not cased or word[0].isupper()

    def plain(word: str) -> bool:
        return any(p.lower() in common or p.lower() in NOUNS for p in re.split(r"['’-]", word) if len(p) > 1)

    at = 0
    while m := _PAIR.search(text, at):
        first, family = m["first"], m["family"]
        at = m.end("first")
        if not (capital(first) and capital(family)) or len(family) < 3 or plain(family):
            continue
        if _bare(first) in GIVEN or _bare(first) in given or (len(first) == 1 and m["mark"]):
            before = re.search(rf"(?<![\w@.]){_TITLE}\.?\s+$", text[: m.start()], re.I)
            found.append((before.start() if before else m.start(), m.end()))
            at = m.end()
        elif not plain(first) and len(first) > 1 and not m["mark"] and not (cased and len(family) <= 3 and family.isupper()):
            unsure.append(m.span())
    for m in _REVERSED.finditer(text):
        if capital(m["first"]) and capital(m["family"]) and not plain(m["family"]):
            if _bare(m["first"]) in GIVEN or _bare(m["first"]) in given:
                found.append(m.span())
            elif not plain(m["first"]):
                unsure.append(m.span())
    for m in _TITLED.finditer(text):
        if capital(m["title"]) and capital(m["family"]) and not plain(m["family"]) and _bare(m["family"]) not in GIVEN:
            found.append(m.span())
    return found, unsure


def label(text: str, common: set[str], given: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(spans: start, end, kind, without overlaps, addresses and numbers first; unsure spans)."""
    taken: list[tuple[int, int, str]] = []
    named, unsure = names(text, common, given)
    for kind in KINDS:
        for lo, hi in named if kind == "person_name" else shaped(kind, text):
            if all(hi <= a or lo >= b for a, b, _ in taken):
                taken.append((lo, hi, kind))
    return sorted(taken), [(lo, hi) for lo, hi in unsure if all(hi <= a or lo >= b for a, b, _ in taken)]
