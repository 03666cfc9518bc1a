"""Grouping glyphs to lines, blocks, words and spans; wrapping and placing text. The relational forms are in folia.operators and folia.functions."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

from folia.pdf.fonts import text_width

#: The least distance of baselines of two lines in sizes and in points, the gap of two blocks in line heights,
#: the gap of two words in sizes, and how far a baseline lies under the top of its line in sizes.
LINE_GAP, LEAST_LINE_GAP, BLOCK_GAP, WORD_GAP, ASCENT = 0.5, 3.0, 0.8, 0.25, 0.8
#: What counts as blank.
BLANK = "\0\t\n\x0b\x0c\r "


class Glyph(NamedTuple):
    code: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    ox: float
    oy: float
    size: float
    seq: int = 0


def tenth(value: float) -> float:
    """Rounded to one decimal, halves away from zero."""
    return float(Decimal(repr(value)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def bbox(items) -> tuple:
    return (min(g.x0 for g in items), min(g.y0 for g in items), max(g.x1 for g in items), max(g.y1 for g in items)) if items else (0.0,) * 4


def lines(glyphs: list[Glyph]) -> list[list[Glyph]]:
    """Glyphs by baseline and place; a line goes on while baselines stay near that of its first glyph."""
    out: list[list[Glyph]] = []
    base = 0.0
    for g in sorted(glyphs, key=lambda g: (tenth(g.oy), g.ox, g.seq)):
        if not out or abs(g.oy - base) > max(LINE_GAP * g.size, LEAST_LINE_GAP):
            out.append([])
            base = g.oy
        out[-1].append(g)
    return [sorted(line, key=lambda g: (g.ox, g.seq)) for line in out]


def blocks(found: list[list[Glyph]]) -> list[list[list[Glyph]]]:
    out: list[list[list[Glyph]]] = []
    bottom = None
    for line in found:
        top, height = min(g.y0 for g in line), max(g.y1 - g.y0 for g in line)
        if bottom is None or top - bottom > BLOCK_GAP * height:
            out.append([])
        out[-1].append(line)
        bottom = max(g.y1 for g in line)
    return out


def _apart(before: Glyph | None, g: Glyph) -> bool:
    return before is not None and g.x0 - before.x1 > WORD_GAP * before.size


def line_text(line: list[Glyph]) -> str:
    out, before = "", None
    for g in line:
        if _apart(before, g) and g.text != " " and not out.endswith(" "):
            out += " "
        out += g.text
        before = g
    return out.rstrip(BLANK)


def line_words(line: list[Glyph]) -> list[list[Glyph]]:
    out: list[list[Glyph]] = []
    before = None
    for g in line:
        if not g.text.strip(BLANK):
            before = None
            continue
        if before is None or _apart(before, g):
            out.append([])
        out[-1].append(g)
        before = g
    return out


def line_spans(line: list[Glyph]) -> list[list[Glyph]]:
    out: list[list[Glyph]] = []
    for g in line:
        if not out or out[-1][-1].size != g.size:
            out.append([])
        out[-1].append(g)
    return out


def page_text(found: list[list[list[Glyph]]]) -> str:
    text = "\n\n".join("\n".join(map(line_text, block)) for block in found)
    return re.sub(r"[ \t]+\n", "\n", text).strip(BLANK)


def wrap(text: str | None, font: str, size: float, width: float) -> list[str]:
    """Words line by line as they fit; line ends stay, and a word wider than the box has a line of its own."""
    out = []
    for paragraph in (text or "").split("\n"):
        line = ""
        for word in paragraph.rstrip(" ").split(" "):
            longer = f"{line} {word}" if line else word
            if line and width > 0 and text_width(font, longer, size) > width:
                out.append(line)
                longer = word
            line = longer
        out.append(line)
    return out


def place(rect, text, font: str, size: float, align="center", valign="center", spacing=1.2) -> tuple[list[tuple[float, float, str]], tuple]:
    """((x, baseline from the page's top, text) of each line, the bounds used). The core default is the top; text boxes center."""
    x0, y0, x1, y1 = rect
    found = wrap(text, font, size, x1 - x0)
    step = size * spacing
    total = len(found) * step
    top = {"center": y0 + (y1 - y0 - total) / 2.0, "bottom": y1 - total}.get(valign, y0)
    placed, low, high = [], x1, x0
    for k, line in enumerate(found):
        w = text_width(font, line, size)
        x = {"center": x0 + (x1 - x0 - w) / 2.0, "right": x1 - w}.get(align, x0)
        placed.append((x, top + k * step + size * ASCENT, line))
        low, high = min(low, x), max(high, x + w)
    return placed, (low, top, high, top + total)
