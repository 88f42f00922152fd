"""Splitting oversized items at natural boundaries by structure-tree packing.

A text is a tree: sections by heading level, markup elements by nesting, blocks between blank lines, list items by indentation, lines (table
rows), sentences, words, characters. A node within the budget is kept whole; only an oversized node is descended into. Whole siblings are
merged bottom-up as long as they fit; what is left of an oversized node is never merged with its siblings, so no piece reaches from within one section
into the next. Sizes are tokens of a public tokenizer; each piece after the first starts with the last ``overlap`` tokens of the piece before.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import tokens
from lakewarden.runtime import spread

HEADING = re.compile(r"^(#{1,6})[ \t]+\S.*$", re.M)
MARKUP_HEADING = re.compile(r"(?:<(?:section|article|main|div|header)\b[^>]*>\s*)*<h([1-6])\b[^>]*>", re.I)  # with the elements it opens
MARKUP_HEADING_END = re.compile(r"</h[1-6]\s*>\s*", re.I)
#: Markup elements that hold blocks (fixed values).
ELEMENT = re.compile(r"<(/?)(section|article|main|div|blockquote|ul|ol|dl|li|dt|dd|table|tr|p)\b[^>]*>", re.I)
FENCE = re.compile(r"^[ \t]*(?:```|~~~).*$", re.M)
BLOCK = re.compile(r"\n[ \t\r]*\n\s*")
LIST_ITEM = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,3}[.)]|[a-z][.)])[ \t]+(?=\S)", re.M)
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?。！？…][\"'”’)\]]*\s+")


def atoms(text: str, encode, most: int, pattern, sizes: dict[str, int], tags: list[int]) -> tuple[list[int], list[int]]:
    """Offsets and cumulative token counts of the pre-tokens; one that holds the beginning of a tag is cut there, one above ``most`` tokens between characters."""
    starts: list[int] = []
    counts: list[int] = []
    for m in pattern.finditer(text):
        piece = m.group()
        if tags and "<" in piece[1:]:
            k = bisect_right(tags, m.start())
            if k < len(tags) and tags[k] < m.end():
                edges = [m.start(), *tags[k : bisect_left(tags, m.end())], m.end()]
                starts += edges[:-1]
                counts += [len(encode(text[a:b])) for a, b in zip(edges, edges[1:])]
                continue
        n = sizes.get(piece)
        if n is None:
            n = len(encode(piece))
            if len(sizes) < 500_000 and len(piece) < 40:
                sizes[piece] = n
        if n <= most:
            starts.append(m.start())
            counts.append(n)
            continue
        at = 0
        while at < len(piece):
            step = len(piece) - at
            while step > 1 and len(encode(piece[at : at + step])) > most:
                step = (step + 1) // 2
            starts.append(m.start() + at)
            counts.append(len(encode(piece[at : at + step])))
            at += step
    starts.append(len(text))
    return starts, [0, *accumulate(counts)]


def levels_of(text: str) -> list[tuple[str, list[int]]]:
    """Boundaries (character offsets where a child begins) from the outermost level of the tree to the innermost.

    Nothing within a code fence is a heading, an item or a block of its own; a heading stays with what follows it.
    """
    marks = [m.start() for m in FENCE.finditer(text)]
    fences = list(zip(marks[::2], [*marks[1::2], len(text)]))
    opened = [lo for lo, _ in fences]

    def free(at: int) -> bool:
        k = bisect_right(opened, at) - 1
        return k < 0 or at <= fences[k][0] or at > fences[k][1]

    headings: dict[int, list[int]] = {}
    glued: set[int] = set()  # where the text beneath a heading begins
    for m in HEADING.finditer(text):
        if free(m.start()):
            headings.setdefault(len(m.group(1)), []).append(m.start())
            glued.add(re.compile(r"\s*").match(text, m.end()).end())
    for m in MARKUP_HEADING.finditer(text):
        if free(m.start()):
            headings.setdefault(int(m.group(1)), []).append(m.start())
            if end := MARKUP_HEADING_END.search(text, m.end()):
                glued.add(end.end())
    out = [(f"heading {k}", sorted(headings[k])) for k in sorted(headings)]
    elements: dict[int, list[int]] = {}
    depth = 0
    for m in ELEMENT.finditer(text):
        if m.group(1):
            depth = max(0, depth - 1)
        else:
            depth += 1
            elements.setdefault(depth, []).append(m.start())
    out += [(f"element {k}", elements[k]) for k in sorted(elements)]
    items: dict[int, list[int]] = {}
    for m in LIST_ITEM.finditer(text):
        if free(m.start()):
            items.setdefault(len(m.group(1).expandtabs(4)), []).append(m.start())
    nested = {at + len(re.compile(r"[ \t]*").match(text, at).group()) for k in list(sorted(items))[1:] for at in items[k]}  # part of the item above, blank line or not
    out.append(("block", [m.end() for m in BLOCK.finditer(text) if free(m.end()) and m.end() not in nested]))
    out += [(f"item {k}", items[k]) for k in sorted(items)]
    out.append(("line", [m.end() for m in LINE.finditer(text)]))
    out.append(("sentence", [m.end() for m in SENTENCE.finditer(text)]))
    return [(name, [at for at in places if at not in glued]) for name, places in out]


def split_text(text: str, limit: int, overlap: int, encode, pattern, sizes: dict[str, int] | None = None) -> list[tuple[int, int, int, str]]:
    """[(body start, start with overlap, end, boundary the piece begins at)], in character offsets; bodies tile the text."""
    overlap = max(0, min(overlap, limit // 2))
    slack = 2 if limit - overlap > 8 else 0  # a cut can change the tokens at its two edges
    rest = max(1, limit - overlap - slack)
    tree = levels_of(text)
    tags = sorted({at for name, places in tree if name.startswith(("heading", "element")) for at in places if text[at : at + 1] == "<"})
    starts, total = atoms(text, encode, rest, pattern, {} if sizes is None else sizes, tags)
    last = len(starts) - 1
    # atom indexes of the boundaries, level by level; a boundary inside an atom (newlines and blanks are one) counts from the next one
    levels = [(name, sorted({bisect_left(starts, p) for p in places})) for name, places in tree]
    levels.append(("word", [i for i in range(last) if i and text[starts[i]].isspace()]))

    def fits(lo: int, hi: int) -> bool:
        return total[hi] - total[lo] <= (rest if lo else max(rest, limit - slack))  # nothing overlaps before the first piece

    def pack(children: list[list[tuple[int, int, str]]]) -> list[tuple[int, int, str]]:
        """Whole siblings side by side become one piece while they fit; the pieces of an oversized child stay its own."""
        out: list[tuple[int, int, str]] = []
        mergeable = False
        for parts in children:
            whole = len(parts) == 1
            if whole and mergeable and fits(out[-1][0], parts[0][1]):
                out[-1] = (out[-1][0], parts[0][1], out[-1][2])
            else:
                out += parts
            mergeable = whole
        return out

    def cut(lo: int, hi: int, name: str, depth: int) -> list[tuple[int, int, str]]:
        if fits(lo, hi):
            return [(lo, hi, name)]
        while depth < len(levels):
            label, places = levels[depth]
            inner = places[bisect_right(places, lo) : bisect_left(places, hi)]
            depth += 1
            if inner:
                edges = [lo, *inner, hi]
                return pack([cut(edges[k], edges[k + 1], name if k == 0 else label, depth) for k in range(len(edges) - 1)])
        return pack([[(i, i + 1, name if i == lo else "character")] for i in range(lo, hi)])

    out = []
    for k, (lo, hi, name) in enumerate(cut(0, last, "start", 0) if last else []):
        start = starts[lo]
        if k and overlap:
            # the shortest run of whole atoms before the piece with at least ``overlap`` tokens that still leaves it within the limit
            begin = bisect_right(total, total[lo] - overlap) - 1
            begin = at = max(begin, 0)
            start = starts[begin]
            if len(encode(text[start : starts[hi]])) > limit:
                # the word the overlap starts in is too long: start within it, where overlap and limit both hold
                inside = range(start + 1, starts[begin + 1])
                fitting = (x for x in inside if len(encode(text[x : starts[hi]])) <= limit and len(encode(text[x : starts[lo]])) >= overlap)
                start = next(fitting, -1)
                while start < 0:
                    at += 1
                    if at >= lo or len(encode(text[starts[at] : starts[hi]])) <= limit:
                        start = starts[min(at, lo)]
        out.append((starts[lo], start, starts[hi], name))
    return out


def oversized(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind_col: str = "doc_type", folder: str = tokens.FOLDER) -> DataFrame:
    """(id, text, max_tokens, overlap_tokens, tokens) of the items above the limit of their kind.

    Items of a kind without a limit, null ids and null and empty texts, are never oversized; limits are one row a kind (the lowest if repeated).
    A text of at most as many bytes as the limit has tokens is within it (no token is shorter than a byte) and is not tokenised.
    """
    lim = limits.where("max_tokens > 0").groupBy(F.col(kind_col).alias("kind")).agg(F.min("max_tokens").alias("max_tokens"), F.max("overlap_tokens").alias("overlap_tokens"))
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(kind_col).alias("kind")).where("id is not null and length(text) > 0"))
    rows = rows.join(lim, "kind").where("octet_length(text) > max_tokens")
    return rows.withColumn("tokens", tokens.token_count(F.col("text"), folder)).where("tokens > max_tokens").select(F.col("id").alias(id_col), "text", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"), "tokens")


def pieces(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind_col: str = "doc_type", folder: str = tokens.FOLDER) -> DataFrame:
    """(id, piece, pieces, boundary, body_start, start, end, tokens, text), one row a piece of each oversized item, in order.

    Bodies ``[body_start, end)`` tile the text exactly; ``text`` is ``[start, end)`` with the overlap before it. Every piece is within the
    limit; only where one character alone has more tokens than the limit is that character a piece of its own. The overlap is the shortest
    run of whole words with at least ``overlap_tokens`` tokens; it starts within a word, or is shorter, only where the limit demands it.
    """
    big = oversized(docs, limits, id_col, text_col, kind_col, folder)
    kind = dict(big.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        encode, pattern, sizes = tokens.encoder(folder).encode_ordinary, regex.compile(tokens.PATTERN), {}
        for b in batches:
            rows = []
            for i, text, limit, overlap in zip(b[id_col], b["text"], b["max_tokens"], b["overlap_tokens"]):
                parts = split_text(text, int(limit), int(overlap), encode, pattern, sizes)
                for k, (body, start, end, name) in enumerate(parts):
                    piece = text[start:end]
                    rows.append((i, k, len(parts), name, body, start, end, len(encode(piece)), piece))
            yield pd.DataFrame(rows, columns=[id_col, "piece", "pieces", "boundary", "body_start", "start", "end", "tokens", "text"])

    return big.select(id_col, "text", "max_tokens", "overlap_tokens").mapInPandas(run, f"{id_col} {kind}, piece int, pieces int, boundary string, body_start int, start int, end int, tokens int, text string")
