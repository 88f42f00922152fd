"""Noise in text from scanned pages: words broken over lines, misrecognised characters, running lines and page numbers.

Repair is a noisy channel: a seen word s is explained by an intended word w at P(s | w) from a table of character confusions, and w by an
n-gram model of the corpus (word bigrams backed off to unigrams, and character trigrams for words outside the vocabulary, such as names). Each
line is decoded by Viterbi over the candidate words of its tokens. Words broken over a line end are joined if the joined word is likelier than
the hyphenated one; running lines are those that stand between the lines of a sentence or repeat with other numbers.

The model holds words, bigrams and trigrams above fixed shares of the corpus, counted over all texts: its size is bounded whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.runtime import spread

#: What a scanner reads -> what stood there, with the chance of the misreading.
CONFUSIONS = {
    "0": (("o", 0.004),), "1": (("l", 0.004), ("i", 0.003)), "5": (("s", 0.004),), "9": (("g", 0.003),), "8": (("b", 0.002),), "6": (("b", 0.001),),
    "c": (("e", 0.003),), "e": (("c", 0.001),), "i": (("l", 0.002),), "l": (("i", 0.003),), "f": (("t", 0.002),), "t": (("f", 0.0005),),
    "rn": (("m", 0.004),), "m": (("rn", 0.001),), "ri": (("n", 0.003),), "li": (("h", 0.003),), "cl": (("d", 0.004),), "d": (("cl", 0.0005),), "ii": (("u", 0.003),), "vv": (("w", 0.004),),
    "à": (("a", 0.004),), "ﬀ": (("ff", 0.02),), "ﬁ": (("fi", 0.02),), "ﬂ": (("fl", 0.02),), "ﬃ": (("ffi", 0.02),), "ﬄ": (("ffl", 0.02),),
}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
# each pattern starts at the beginning of a run of letters only, so that a very long run is read once
COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]{2,}-[^\W\d_]{2,}")
BREAK = re.compile(r"(?<![^\W\d_])([^\W\d_]+)([-‐­¬])[ \t]*\n[ \t]*([^\W\d_]+)")
LIGATURE = re.compile("[ﬀ-ﬄ]")
PAGE = re.compile(r"^\W{0,3}(?:(?:page|pág(?:ina)?\.?|pag\.?|seite|p\.|s\.)\s*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?\W{0,3}$", re.I)
TITLE_WORD = r"[^\W\d_][\w'’\-]*"
REVISION = r"(?:\s{2,}(?:Rev|Ver|Vers|v)\.? ?\d[\d.]*)?"
NUMBERED_TITLE = re.compile(rf"^(?:\d{{1,4}}\s{{2,}}{TITLE_WORD}(?: {TITLE_WORD}){{0,6}}|{TITLE_WORD}(?: {TITLE_WORD}){{0,6}}\s{{2,}}\d{{1,4}})$")
PARTED_TITLE = re.compile(rf"^{TITLE_WORD}(?: {TITLE_WORD}){{0,6}} [|–—·] {TITLE_WORD}(?: {TITLE_WORD}){{0,3}}$")
PLAIN_TITLE = re.compile(rf"^{TITLE_WORD}(?: {TITLE_WORD}){{1,6}}{REVISION}$")
MARKED = re.compile(r"^\s*(?:[#|>*•]|[-–] |\d{1,3}[.)] |[a-z][.)] )")
NUMBERING = re.compile(r"^(?:\d{1,3}|[a-z])[.)]$|^[#|>*•]")
UNKNOWN = 1e-3
NAME_DOUBT = math.log(1e-3)
RARE = -6.0
#: Longer tokens are no words and stay as they are.
LONGEST = 40
COMMONER = math.log(80)
LOWER_RUN = re.compile(r"(?<![^\W\d_A-ZÀ-Þ])[^\W\d_A-ZÀ-Þ]++(?:[ \n][^\W\d_A-ZÀ-Þ]+)+")
WORD_SHARE, PAIR_SHARE, TRIGRAM_SHARE = 2e-4, 5e-4, 1e-6


@dataclass
class Model:
    """Log-probabilities of a corpus; words in lower case."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    trigrams: dict[str, float] = field(default_factory=dict)
    doubtful: dict[str, list] = field(default_factory=dict)

    def spelling(self, word: str) -> float:
        """Log-likelihood of a word outside the vocabulary, by its character trigrams."""
        shape = f"^{word}$"
        t = self.trigrams
        return math.log(UNKNOWN) + sum(t.get(shape[max(0, i - 2) : i + 1], -12.0) for i in range(1, len(shape)))

    def odd(self, word: str) -> bool:
        """Whether the spelling has a trigram that is rare in the corpus."""
        shape = f"^{word}$"
        t = self.trigrams
        return any(t.get(shape[max(0, i - 2) : i + 1], -12.0) < RARE for i in range(1, len(shape)))

    def likelihood(self, word: str, before: str | None) -> float:
        one = self.words.get(word)
        if one is None:
            return self.spelling(word)
        two = self.pairs.get((before, word)) if before else None
        return one if two is None else math.log(0.3 * math.exp(one) + 0.7 * math.exp(two))


def readings(seen: str, model: Model, name: bool = False, most: int = 2) -> list[tuple[str, float]]:
    """Candidate words of a seen word (lower case) with log P(seen | word), the seen word first.

    Candidates are words of the vocabulary; a ``name`` may also be respelled, if its own spelling is rare.
    """
    if name and not model.odd(seen):
        return [(seen, 0.0)]
    found = {seen: 0.0}
    edge = [(seen, 0.0, 0)]
    for _ in range(most):
        grown = []
        for word, cost, start in edge:
            for i in range(start, len(word)):
                for size in (1, 2):
                    for meant, chance in CONFUSIONS.get(word[i : i + size], ()) if i + size <= len(word) else ():
                        new = word[:i] + meant + word[i + size :]
                        c = cost + math.log(chance)
                        if c > found.get(new, -1e9):
                            found[new] = c
                            grown.append((new, c, i + len(meant)))
        edge = grown
    known = [(w, c) for w, c in found.items() if w in model.words and w != seen]
    named = [] if known or not name or seen[-1].isdigit() else [(w, c) for w, c in found.items() if w != seen and not any(x.isdigit() for x in w)]
    # outside the vocabulary a spelling alone must outweigh NAME_DOUBT, unless digits stand among letters
    doubt = 0.0 if any(x.isdigit() for x in seen) else NAME_DOUBT
    named = [(w, c + doubt) for w, c in named]
    named.sort(key=lambda x: -(x[1] + model.spelling(x[0])))
    return [(seen, 0.0), *known, *named[:3]]


def plausible(token: str) -> bool:
    """Whether the token can be a misread word: letters, or letters with a few digits among them."""
    digits = sum(c.isdigit() for c in token)
    if not digits:
        return 3 <= len(token) <= LONGEST
    letters = len(token) - digits
    return digits <= 2 and 3 <= letters <= LONGEST and not token[-2:].isdigit()


class Speller:
    """Readings of tokens, remembered within a task."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.certain = model.words.keys() - model.doubtful.keys()

    def options(self, token: str) -> list[tuple[str, float]]:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            seen = token.lower()
            if seen in self.model.doubtful:
                found = self.model.doubtful[seen]
            elif seen in self.model.words or not plausible(seen):
                found = [(seen, 0.0)]
            else:
                found = readings(seen, self.model, token[0].isupper())
            self.memo[token] = found
        return found

    def uncertain(self, text: str) -> bool:
        """Whether any token of the text has more than one reading."""
        return any(len(self.options(t)) > 1 for t in set(TOKEN.findall(text)) - self.certain)


def decode(tokens: list[str], speller: Speller) -> list[str]:
    """The likeliest intended words (lower case) of a line's tokens, by Viterbi."""
    model = speller.model
    scores: dict[str, float] = {"": 0.0}
    links: list[dict[str, str]] = []
    for token in tokens:
        new: dict[str, float] = {}
        link: dict[str, str] = {}
        for word, cost in speller.options(token):
            best, where = max((s + model.likelihood(word, before or None), before) for before, s in scores.items())
            new[word], link[word] = best + cost, where
        scores = new
        links.append(link)
    out = [max(scores, key=lambda w: scores[w])]
    for link in reversed(links[1:]):
        out.append(link[out[-1]])
    return out[::-1]


def recased(seen: str, meant: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return meant.upper()
    return meant[:1].upper() + meant[1:] if seen[:1].isupper() else meant


def in_address(line: str, start: int, end: int) -> bool:
    """Whether the token is part of a mail address, link or file name, whose spelling follows no language."""
    lo, hi = line.rfind(" ", 0, start) + 1, line.find(" ", end)
    around = line[lo : hi if hi >= 0 else len(line)].rstrip(".,;:!?)")
    return "@" in around or "://" in around or re.search(r"\w[._]\w", around) is not None


def running_lines(lines: list[str]) -> set[int]:
    """Indexes of running headers, footers and page numbers standing among the lines; never the first line with text."""
    bodies = [x.strip() for x in lines]
    filled = [i for i, x in enumerate(bodies) if x]
    found: set[int] = set()
    masked = Counter(re.sub(r"\d+", "0", bodies[i]) for i in filled if len(bodies[i]) <= 70)

    def title(i: int) -> int:
        x = bodies[i]
        if len(x) > 70 or MARKED.match(lines[i]) or x[-1] in ".!?:;,":
            return 0
        if NUMBERED_TITLE.match(x) or PARTED_TITLE.match(x) or (PLAIN_TITLE.match(x) and re.search(REVISION[:-1] + "$", x)):
            return 2
        if PLAIN_TITLE.match(x) and (x.isupper() or all(not w[0].islower() for w in x.split() if len(w) > 3)):
            return 1
        return 0

    kinds = {i: 3 if PAGE.match(bodies[i]) and not NUMBERING.match(bodies[i]) else title(i) for i in filled}
    for place, i in enumerate(filled):
        kind = kinds[i]
        if not kind or place == 0:
            continue
        before = next((bodies[j] for j in reversed(filled[:place]) if not kinds[j]), "")
        after = next((bodies[j] for j in filled[place + 1 :] if not kinds[j]), "")
        apart = (i == 0 or not bodies[i - 1]) and (i + 1 >= len(bodies) or not bodies[i + 1])
        # a sentence goes on beneath the line, or its first line is cut at a hyphen
        shouted = bodies[i].isupper() and not before.isupper() and after[:1].isalpha() and not before.split()[-1:][0][:1].isupper() if before else False
        broken = bool(before) and before[-1] not in ".!?:|" and (after[:1].islower() or before[-1] in "-‐­¬" or shouted) and not MARKED.match(after)
        repeats = masked[re.sub(r"\d+", "0", bodies[i])] > 1
        if kind == 3 or (kind == 2 and before and not apart) or (kind == 1 and (broken or repeats)):
            found.add(i)
    return found


def repair(text: str, speller: Speller) -> tuple[str, int, int, int]:
    """(continuous text, words joined, words corrected, lines removed). Mere typing slips (letters swapped) are left as they are."""
    model = speller.model
    lines = text.split("\n")
    gone = running_lines(lines) if len(lines) > 1 else set()
    kept: list[str] = []
    apart = False  # a blank line beside a removed line does not end a sentence
    for i, x in enumerate(lines):
        if i in gone:
            apart = True
            while kept and not kept[-1].strip():
                kept.pop()
        elif x.strip():
            if apart and kept and kept[-1].rstrip()[-1] in ".!?:|" and i and not lines[i - 1].strip():
                kept.append("")
            kept.append(x)
            apart = False
        elif not apart:
            kept.append(x)
    joined = 0

    def join(m: re.Match) -> str:
        nonlocal joined
        left, mark, right = m.groups()
        whole, compound = (left + right).lower(), f"{left}-{right}".lower()
        if mark in "-‐":
            if compound in model.words and model.words[compound] >= model.words.get(whole, -1e9):
                return f"{left}-{right}"
            if whole not in model.words and left.lower() in model.words and right.lower() in model.words and min(len(left), len(right)) > 3 and model.spelling(whole) < model.words[left.lower()] + model.words[right.lower()]:
                return f"{left}-{right}"
        joined += 1
        return left + right

    body = "\n".join(kept)
    if len(kept) > 1:
        body = BREAK.sub(join, body)
    corrected = 0
    if speller.uncertain(body):
        out: list[str] = []
        for line in body.split("\n"):
            places = list(TOKEN.finditer(line)) if speller.uncertain(line) else []
            if places:
                parts, at = [], 0
                for m, meant in zip(places, decode([m.group() for m in places], speller)):
                    seen = m.group().lower()
                    if seen != meant and sorted(seen) != sorted(meant) and not in_address(line, m.start(), m.end()):
                        corrected += 1
                        parts += [line[at : m.start()], recased(m.group(), meant)]
                        at = m.end()
                line = "".join(parts) + line[at:]
            out.append(line)
        body = "\n".join(out)
    if not (joined or corrected or gone or LIGATURE.search(body)):
        return text, 0, 0, 0
    paragraphs: list[str] = []
    open_ = False
    for line in body.split("\n"):
        if not line.strip():
            open_ = False
        elif open_ and not MARKED.match(line):
            paragraphs[-1] += " " + line.strip()
        else:
            paragraphs.append(line.rstrip() if MARKED.match(line) else line.strip())
            open_ = True
    return "\n".join(paragraphs), joined, corrected, len(gone)


def learn(texts: DataFrame) -> Model:
    """The corpus model of a single-column frame of texts, counted over all of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        texts = 0

        def flush() -> pd.DataFrame:
            rows = [("w", w, n) for w, n in words.items()] + [("p", f"{a} {b}", n) for (a, b), n in pairs.items()] + [("n", "", texts)]
            return pd.DataFrame(rows, columns=["kind", "key", "n"])

        for b in batches:
            for text in b.iloc[:, 0]:
                if not text:
                    continue
                texts += 1
                words.update(TOKEN.findall(text.lower()))
                for run in LOWER_RUN.findall(text):  # names, numbers and codes have no bigrams worth counting
                    run = run.split()
                    pairs.update(zip(run, run[1:]))
                words.update(x.lower() for x in COMPOUND.findall(text))
                if len(words) + len(pairs) > 400_000:
                    yield flush()
                    words.clear()
                    pairs.clear()
                    texts = 0
        yield flush()

    totals = texts.mapInPandas(count, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).persist()
    try:
        n = (totals.where("kind = 'n'").select("n").first() or [0])[0]
        rows = totals.where(((F.col("kind") == "w") & (F.col("n") > n * WORD_SHARE)) | ((F.col("kind") == "p") & (F.col("n") > n * PAIR_SHARE))).where("n > 2").toPandas()

        def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: Counter = Counter()
            for b in batches:
                for w in b["key"]:
                    if w.isalpha():
                        shape = f"^{w}$"
                        counts.update(shape[max(0, i - 2) : i + 1] for i in range(1, len(shape)))
            yield pd.DataFrame(list(counts.items()), columns=["key", "n"]).astype({"key": "str", "n": "int64"})

        # names and other rare words, each spelling once
        tri = totals.where((F.col("kind") == "w") & (F.col("n") <= n * WORD_SHARE + 2)).select("key").mapInPandas(shapes, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
        all_tri = tri.agg(F.sum("n")).first()[0] or 0
        shown = tri.where(F.col("n") > all_tri * TRIGRAM_SHARE).toPandas()
    finally:
        totals.unpersist()
    model = Model()
    one = rows[rows["kind"] == "w"]
    total = max(1, int(one["n"].sum()))
    model.words = {k: math.log(v / total) for k, v in zip(one["key"], one["n"])}
    counts = dict(zip(one["key"], one["n"]))
    two = rows[rows["kind"] == "p"]
    for k, v in zip(two["key"], two["n"]):
        a, b = k.split(" ")
        if a in counts and b in counts:
            model.pairs[a, b] = math.log(v / counts[a])
    context: Counter = Counter()
    for k, v in zip(shown["key"], shown["n"]):
        context[k[:-1]] += v
    model.trigrams = {k: math.log((v + 0.01) / (context[k[:-1]] + 1)) for k, v in zip(shown["key"], shown["n"])}
    # a word that one confusion turns into a far commoner one is a misreading frequent enough to be counted: it is no word
    for w, p in list(model.words.items()):
        if plausible(w):
            others = [(x, c) for x, c in readings(w, model, most=1)[1:] if model.words[x] > p]
            if any(model.words[x] - p > COMMONER for x, _ in others):
                del model.words[w]
            elif others:
                model.doubtful[w] = [(w, 0.0), *others]
    return model


def repaired(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, joined, corrected, removed): texts with a trace of scanning, repaired into continuous paragraphs.

    Null and empty texts have no trace, rows with a null id are left out; repeated rows give one row; whole texts are read. List items, table rows and headings keep their
    lines. Of an id with several contents the one that sorts first is returned.
    """
    rows = spread(records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0"))
    shared = records.sparkSession.sparkContext.broadcast(learn(rows.select("text")))
    kind = dict(records.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = Speller(shared.value)
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["text"]):
                fixed, joined, corrected, removed = repair(text, speller)
                if joined or corrected or removed or LIGATURE.search(text):
                    out.append((i, LIGATURE.sub(lambda m: CONFUSIONS[m.group()][0][0], fixed), joined, corrected, removed))
            yield pd.DataFrame(out, columns=["id", "text", "joined", "corrected", "removed"])

    return rows.mapInPandas(run, f"id {kind}, text string, joined int, corrected int, removed int").groupBy("id").agg(F.min(F.struct("text", "joined", "corrected", "removed")).alias("r")).select(F.col("id").alias(id_col), "r.*")
