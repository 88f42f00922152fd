"""Reading order and tables of laid-out pages, from word boxes and ruled lines; a PDF or OCR reader delivers the boxes.

A word is (text, x0, x1, top, bottom, size). Everything here works on one page at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import median

LINE_TOLERANCE, GUTTER, BLOCK_LINES = 3.0, 12.0, 3


@dataclass(frozen=True)
class Word:
    text: str
    x0: float
    x1: float
    top: float
    bottom: float
    size: float = 10.0


def lines_of(words: Sequence[Word], tolerance: float = LINE_TOLERANCE) -> list[list[Word]]:
    """Words whose tops differ by at most ``tolerance`` from the line's first, left to right, from the top down."""
    out: list[list[Word]] = []
    for w in sorted(words, key=lambda w: (w.top, w.x0)):
        if out and w.top - out[-1][0].top <= tolerance:
            out[-1].append(w)
        else:
            out.append([w])
    return [sorted(x, key=lambda w: w.x0) for x in out]


def gutters(words: Sequence[Word], least: float = GUTTER) -> list[tuple[float, float]]:
    """Vertical strips, at least ``least`` wide, that no word enters."""
    found, reach = [], None
    for lo, hi in sorted((w.x0, w.x1) for w in words):
        if reach is not None and lo - reach >= least:
            found.append((reach, lo))
        reach = hi if reach is None else max(reach, hi)
    return found


def reading_order(words: Sequence[Word], width: float) -> list[str]:
    """Lines of a page as read: lines spanning the columns where they stand, the columns between them one after the other.

    A block of at least BLOCK_LINES lines with a common gutter is set in columns; a column narrower than a sixth of the page is no column but part of
    its neighbour.
    """
    out: list[str] = []
    block: list[list[Word]] = []

    def text(line: Sequence[Word]) -> str:
        return " ".join(w.text for w in line)

    def flush() -> None:
        if not block:
            return
        inside = [w for line in block for w in line]
        cuts = [(a + b) / 2 for a, b in gutters(inside)] if len(block) >= BLOCK_LINES else []
        edges = [min(w.x0 for w in inside), *cuts, max(w.x1 for w in inside)]
        kept = [c for i, c in enumerate(cuts) if edges[i + 1] - edges[i] >= width / 6 and edges[i + 2] - edges[i + 1] >= width / 6]
        if not kept:
            out.extend(text(line) for line in block)
        else:
            for lo, hi in zip([float("-inf"), *kept], [*kept, float("inf")]):
                for line in block:
                    own = [w for w in line if lo <= (w.x0 + w.x1) / 2 < hi]
                    if own:
                        out.append(text(own))
        block.clear()

    lines = lines_of(words)
    strip = _common_gutter(lines)
    for line in lines:
        if strip and any(w.x0 < strip[1] and w.x1 > strip[0] for w in line):  # it spans the gutter
            flush()
            out.append(text(line))
        else:
            block.append(line)
    flush()
    return out


def _common_gutter(lines: list[list[Word]]) -> tuple[float, float] | None:
    """The widest gap that most lines leave, if at least BLOCK_LINES lines stand on both sides of it."""
    gaps = [(a.x1, b.x0) for line in lines for a, b in zip(line, line[1:]) if b.x0 - a.x1 >= GUTTER]
    best = None
    for lo, hi in gaps:
        own = [(max(lo, a), min(hi, b)) for a, b in gaps if min(hi, b) - max(lo, a) >= GUTTER]
        if len(own) >= BLOCK_LINES and (best is None or len(own) > best[0]):
            best = (len(own), (max(a for a, _ in own), min(b for _, b in own)))
    return best[1] if best and best[1][1] - best[1][0] >= GUTTER else None


def levels(sizes: Sequence[float], title: float = 2.0, heading: float = 1.5) -> list[int]:
    """Heading level of lines by font size against the page's median: 1 for a title, 2 for a heading, 0 for body."""
    base = median(sizes) if sizes else 1.0
    return [1 if s >= title * base else 2 if s >= heading * base else 0 for s in sizes]


def markdown_table(grid: Sequence[Sequence[str | None]]) -> str:
    """A grid of cells as a pipe table: cells stripped, empty rows dropped, short rows padded."""
    rows = [[" ".join((c or "").split()).replace("|", "\\|") for c in r] for r in grid]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def real_table(grid: Sequence[Sequence[str | None]], rules: int) -> bool:
    """A table has at least two rows, two columns and two drawn rules."""
    return len(grid) >= 2 and max(map(len, grid), default=0) >= 2 and rules >= 2


def caption(lines: Sequence[tuple[float, float, str]], table_top: float, within: float = 24.0) -> str | None:
    """The line (top, bottom, text) that ends closest above a table, within a distance."""
    above = [(table_top - b, t) for _, b, t in lines if 0 <= table_top - b <= within and t.strip()]
    return min(above)[1] if above else None


def needs_ocr(text: str, images: int, tables: int, fewest: int = 50) -> bool:
    """A page with next to no text, at least one image and no tables is read by OCR."""
    return len(text.strip()) < fewest and images > 0 and tables == 0
