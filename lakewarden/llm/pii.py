"""Personal information in free text, tagged by a character-level bidirectional LSTM with CRF transitions.

Every character is one symbol, and all of a text is read: it is cut into overlapping windows that go through
the LSTM in both directions; where windows overlap, each position keeps the scores of the window it lies deeper in, and one Viterbi pass over
the whole text decodes the reconciled scores. The spans are the decoder's: they are only moved to the borders of the words they touch, and dropped
where the definition of their kind cannot hold (a street address without a number). The weights were trained by ``pii_train`` with numpy.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.runtime import spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
WINDOW, OVERLAP = 256, 64
#: Windows computed together.
GROUP = 512
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n.,;:!?'\"()[]{}<>@+-_/\\|#*%&=$€º~^`"
OTHER, OTHER_LOWER, OTHER_UPPER = range(len(ALPHABET) + 1, len(ALPHABET) + 4)
SYMBOLS = len(ALPHABET) + 4


def _symbols() -> np.ndarray:
    """Symbol of every code point of the basic plane; letters with marks are read as their base letters."""
    symbol = np.full(0x10000, OTHER, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if x.islower():
            symbol[c] = OTHER_LOWER
        elif x.isupper() or x.isalpha():
            symbol[c] = OTHER_UPPER
        if c < 0x2100 or 0xFB00 <= c < 0xFF60:
            base = unicodedata.normalize("NFKD", x)[:1]
            base = {"’": "'", "‘": "'", "ʼ": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "ß": "s", "ı": "i", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "\t": " ", "\xa0": " ", "\r": "\n"}.get(x, base)
            if base and base in ALPHABET:
                symbol[c] = ALPHABET.index(base) + 1
    return symbol


SYMBOL = _symbols()
#: Short words that begin or join phrases; a capitalised one is no given name, and one with a number is no street (fixed values).
JOINING = frozenset(
    "the a an in on at of to for from by with and or if when while where once after before since between until under over no not only each every both all this that these those it its as is are was than then should must may can will "
    "der die das den dem des ein eine einen einem einer im am zum zur und oder nur wer wenn nach vor bis seit bei für von mit auf an zu kein keine ohne jede jeder sollte laut "
    "le la les l un une des du de au aux à en et ou si pour dans par sur sans avec depuis entre aucun aucune chaque après "
    "el los las una unos al del y o con sin para por desde tras ninguna cada solo según "
    "january february march april june july august september october november december januar februar märz mai juni juli oktober dezember".split()
)


def codes(text: str) -> np.ndarray:
    """Code points of a text; those beyond the basic plane as one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 0x10000, c, 0xFFFD).astype(np.uint16)


def stretches(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text that are read: all of it."""
    return [(lo, hi) for _, lo, hi in parts_of([text])[1]]


def parts_of(texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(symbols of all texts, one after another; (text, start, end) of what is read of each text: all of it, without empty texts)."""
    return SYMBOL[codes("".join(texts))], [(k, 0, len(t)) for k, t in enumerate(texts) if t]


class Windows(list):
    """Windows of symbols; ``spare`` holds for each how many places at its start and at its end another window scores better."""

    def __init__(self, windows=(), spare=()):
        super().__init__(windows)
        self.spare = list(spare)


class Tagger:
    """Weights of the network, ready to score symbols."""

    def __init__(self, path: str = WEIGHTS):
        with np.load(path, allow_pickle=False) as z:
            w = {k: z[k].astype(np.float32) for k in z.files}
        self.hidden = h = w["Wh_f"].shape[0]
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.table = {d: np.ascontiguousarray(((w["E"] @ w[f"Wx_{d}"] + w[f"b_{d}"]) * half).astype(np.float32).reshape(-1, 4, h).transpose(1, 0, 2)) for d in "fb"}
        # of states, which are kept doubled: the three sigmoid gates apart, and the fourth beside the scores
        self.recur, self.last = {}, {}
        for d, out in (("f", w["Wo"][:h]), ("b", w["Wo"][h:])):
            x = np.hstack([w[f"Wh_{d}"] * half, out]) * np.float32(0.5)
            self.recur[d], self.last[d] = np.ascontiguousarray(x[:, : 3 * h].reshape(h, 3, h).transpose(1, 0, 2)), np.ascontiguousarray(x[:, 3 * h :])
        self.bias, self.trans, self.start = w["bo"], w["trans"], w["start"]
        t = self.trans
        inner, enter, leave = t[1:, 1:] - t[0, 0], t[0, 1:] - t[0, 0], t[1:, 0] - t[0, 0]
        self.inner = max(0.0, float(inner.max()))
        self.cost = self.inner - float(enter.max()) - float(leave.max())
        #: How much less a run costs that begins or ends with its text.
        self.at_start = max(0.0, float((self.start[1:] - self.start[0]).max() - enter.max()))
        self.at_end = max(0.0, -float(leave.max()))

    def _run(self, symbols: np.ndarray, d: str) -> np.ndarray:
        """Scores, (n, steps, tags), of (steps, n) symbols in one direction; the gates lie apart, states are doubled."""
        steps, n = symbols.shape
        h, recur, last = self.hidden, self.recur[d], self.last[d]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        z, w, v = np.empty((4, n, h), np.float32), np.empty((3, n, h), np.float32), np.empty((n, last.shape[1]), np.float32)
        fourth, score = v[:, :h], v[:, h:]  # the scores are of the step before
        lookups = [(gate.take, to) for gate, to in zip(self.table[d], z)]
        sigmoids, (enter, keep, leave, new) = z[:3], z
        one, half = np.float32(1), np.float32(0.5)
        out = np.empty((n, steps, score.shape[1]), np.float32)
        for t in range(steps):
            for take, to in lookups:
                take(symbols[t], 0, to, "clip")
            np.matmul(state, recur, out=w)
            np.matmul(state, last, out=v)
            if t:
                out[:, t - 1] = score
            np.add(sigmoids, w, out=sigmoids)
            np.add(new, fourth, out=new)
            np.tanh(z, out=z)
            np.add(sigmoids, one, out=sigmoids)
            np.multiply(cell, keep, out=cell)
            np.multiply(enter, new, out=enter)
            np.add(cell, enter, out=cell)
            np.multiply(cell, half, out=cell)
            np.tanh(cell, out=state)
            np.multiply(state, leave, out=state)
        out[:, -1] = state @ last[:, h:]
        return out

    def scores(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """(length, tags) emissions of each window, not final in its spare places; parts of similar length are computed together.

        The spare places at the end of a window are not read forward and those at its start not backward: no other place needs their states.
        """
        found = [np.zeros((len(x), len(self.bias)), np.float32) for x in windows]
        spare = getattr(windows, "spare", None) or [(0, 0)] * len(windows)
        for d in "fb":
            size = [len(x) - (hi if d == "f" else lo) for x, (lo, hi) in zip(windows, spare)]
            order = sorted(range(len(windows)), key=size.__getitem__)
            for at in range(0, len(order), GROUP):
                part = order[at : at + GROUP]
                symbols = np.zeros((len(part), size[part[-1]]), np.uint8)
                for row, i in enumerate(part):
                    symbols[row, : size[i]] = windows[i][: size[i]] if d == "f" else windows[i][::-1][: size[i]]
                for e, i in zip(self._run(symbols.T.astype(np.int64, order="C"), d), part):
                    if d == "f":
                        np.add(e[: size[i]], self.bias, out=found[i][: size[i]])
                    else:
                        found[i][len(windows[i]) - size[i] :] += e[: size[i]][::-1]
        return found

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequences, by Viterbi; sequences of similar length are decoded together.

        A run of other tags must win back, over the empty tag, what entering and leaving it costs: only positions in some stretch whose leads together can
        pay for that are decoded, all others have the empty tag on every best path.
        """
        out = [np.zeros(len(e), np.int8) for e in emissions]
        if not out:
            return out
        size = np.fromiter(map(len, emissions), np.int64, len(emissions))
        first = np.cumsum(size) - size
        e = np.concatenate(emissions)
        best = e[:, 1].copy()
        for k in range(2, e.shape[1]):
            np.maximum(best, e[:, k], out=best)
        lead = best - e[:, 0]
        # the most that a stretch through each position can win: highest sum after it less lowest sum before it, in its own text
        text = np.repeat(np.arange(len(size)), size)
        win = lead.astype(np.float64) + self.inner
        total = np.concatenate([[0], np.cumsum(win)])
        before, after = total[:-1] - total[first][text], total[1:] - total[first][text]
        there = size > 0
        before[first[there]] -= self.at_start
        after[(first + size - 1)[there]] += self.at_end
        apart = text * (4 * float(np.abs(win).sum()) + 4 * (self.at_start + self.at_end) + 1)  # each text far below the one before it
        most = np.maximum.accumulate((after - apart)[::-1])[::-1] - np.minimum.accumulate(before - apart)
        open_ = np.nonzero(most >= self.cost - 0.05)[0]
        if not len(open_):
            return out
        own = text[open_]
        gaps = np.nonzero((np.diff(open_) > 2) | (np.diff(own) > 0))[0]
        lo, hi = open_[np.append(0, gaps + 1)], open_[np.append(gaps, len(open_) - 1)] + 1
        own = own[np.append(0, gaps + 1)]
        runs = list(zip(own.tolist(), (lo - first[own]).tolist(), (hi - first[own]).tolist()))
        runs.sort(key=lambda r: r[2] - r[1])
        tags = len(self.bias)
        for at in range(0, len(runs), 2048):
            part = runs[at : at + 2048]
            size = np.array([hi - lo for _, lo, hi in part])
            x = np.zeros((int(size.max()), tags, len(part)), np.float32)
            for j, (k, lo, hi) in enumerate(part):
                x[: hi - lo, :, j] = emissions[k][lo:hi]
            inner = np.array([lo > 0 for _, lo, _ in part])
            score = x[0] + np.where(inner, self.trans[0][:, None], self.start[:, None])
            back = np.zeros((len(x), tags, len(part)), np.int8)
            ended = np.searchsorted(size, np.arange(len(x)), "right").tolist()  # so many of the runs, which are in order of length, are over at each step
            for t in range(1, len(x)):
                on = score[:, ended[t] :]
                best, prior = on[0] + self.trans[0][:, None], back[t, :, ended[t] :]
                for k in range(1, tags):
                    step = on[k] + self.trans[k][:, None]
                    np.copyto(prior, k, where=step > best)
                    np.maximum(best, step, out=best)
                np.add(best, x[t, :, ended[t] :], out=on)
            goes_on = np.array([hi < len(emissions[k]) for k, _, hi in part])
            tag = (score + np.where(goes_on, self.trans[:, :1], 0)).argmax(axis=0)
            found, rows = np.zeros((len(x), len(part)), np.int8), np.arange(len(part))
            for t in range(len(x) - 1, -1, -1):
                found[t] = tag
                tag[ended[t] :] = back[t, tag[ended[t] :], rows[ended[t] :]]
            for j, (k, lo, hi) in enumerate(part):
                out[k][lo:hi] = found[: hi - lo, j]
        return out

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Decoded (start, end, kind) spans of texts, as they come from the network."""
        windows, places = Windows(), []  # places: (stretch, offset within it)
        step = WINDOW - OVERLAP
        symbols, parts = parts_of(texts)
        first = np.cumsum([0, *map(len, texts)]).tolist()
        for j, (k, lo, hi) in enumerate(parts):
            x = symbols[first[k] + lo : first[k] + hi]
            at = 0
            while True:
                windows.append(x[at : at + WINDOW])
                # half of the overlap belongs to either window: the half it lies deeper in
                places.append((j, at))
                windows.spare.append((OVERLAP // 2 if at else 0, OVERLAP // 2 if at + WINDOW < len(x) else 0))
                if at + WINDOW >= len(x):
                    break
                at += step
        emission = [np.empty((hi - lo, len(KINDS) + 1), np.float32) for _, lo, hi in parts]
        for (j, at), (lo, hi), e in zip(places, windows.spare, self.scores(windows)):
            emission[j][at + lo : at + len(e) - hi] = e[lo : len(e) - hi]
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for (k, lo, _), tags in zip(parts, self.decode(emission)):
            if tags.any():
                edges = np.nonzero(np.diff(tags, prepend=0, append=0))[0]
                found[k] += [(lo + int(a), lo + int(b), KINDS[tags[a] - 1]) for a, b in zip(edges[:-1], edges[1:]) if tags[a]]
        return found


_WORD_PART = {"email": re.compile(r"[\w.+%'@-]"), "phone": re.compile(r"[\d+(]"), "id_number": re.compile(r"[^\W_]"), "street_address": re.compile(r"[\w'’-]"), "person_name": re.compile(r"[\w'’-]")}
_AT = re.compile(r"@|\b(?:at|arroba|ät)\b", re.I)
_TRIM = " \n\t.,;:!?|\"[]{}<>*_#=&–—-/"


def possible(kind: str, value: str) -> bool:
    """Whether the definition of a kind can hold: a mail sign, enough digits, a house number and a street, a family name with something before or after it."""
    digits = sum(map(str.isdigit, value))
    if kind == "email":
        return _AT.search(value) is not None and len(value) >= 6
    if kind == "phone":
        return 6 <= digits <= 20
    if kind == "id_number":
        return digits >= 5 and 7 <= sum(map(str.isalnum, value)) <= 20
    letters = [w for w in re.findall(r"[^\W\d_]+", value)]
    if kind == "street_address":
        return digits > 0 and any(len(w) > 2 for w in letters)
    return digits == 0 and len(letters) >= 2 and any(len(w) > 2 for w in letters) and "@" not in value


def bordered(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans at the borders of the words they touch, parts of one find joined, without those that cannot be of their kind."""
    joined: list[list] = []
    for lo, hi, kind in spans:
        if joined and joined[-1][2] == kind and lo - joined[-1][1] <= 2 and "\n" not in text[joined[-1][1] : lo] and "," not in text[joined[-1][1] : lo]:
            joined[-1][1] = hi
        else:
            joined.append([lo, hi, kind])
    found: list[tuple[int, int, str]] = []
    for lo, hi, kind in joined:
        part = _WORD_PART[kind].match
        while lo > 0 and part(text[lo - 1]) and part(text[lo]):
            lo -= 1
        while hi < len(text) and part(text[hi]) and part(text[hi - 1]):
            hi += 1
        while lo < hi and text[lo] in _TRIM + ")":
            lo += 1
        while hi > lo and text[hi - 1] in _TRIM + "(":
            hi -= 1
        if found and lo < found[-1][1]:
            lo = found[-1][1]
        if hi > lo and possible(kind, text[lo:hi]):
            found.append((lo, hi, kind))
    return found


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for lo, hi, kind in spans:
        parts += [text[at:lo], PLACEHOLDER[kind]]
        at = hi
    return "".join(parts) + text[at:]


def personal(records: DataFrame, id_col: str, text_col: str, weights: str = WEIGHTS) -> DataFrame:
    """(id, spans: array<struct<kind, start, end>>, text): records with personal information and their text with typed placeholders.

    Offsets are code points of the original text; everything outside the spans is unchanged. Null and empty texts have none, rows with a null id are left out; repeated rows give
    one row, an id with several contents one row a content; whole texts are read, however long.
    """
    rows = spread(records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0"))
    kind = dict(records.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(weights)
        for b in batches:
            ids, texts = b["id"].tolist(), b["text"].tolist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 2_000_000):  # so many characters are held at once
                    size += len(texts[to])
                    to += 1
                out = []
                for i, text, spans in zip(ids[at:to], texts[at:to], tagger.tag(texts[at:to])):
                    if spans and (spans := bordered(text, spans)):
                        out.append((i, [{"kind": k, "start": lo, "end": hi} for lo, hi, k in spans], redacted(text, spans)))
                yield pd.DataFrame(out, columns=["id", "spans", "text"])
                at = to

    return rows.mapInPandas(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>, text string").distinct().withColumnRenamed("id", id_col)
