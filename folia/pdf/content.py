"""Interpreting a page's content for the glyphs it shows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from folia.errors import Malformed
from folia.pdf.fonts import Font
from folia.pdf.syntax import END, Name, Scanner, Word

#: How far a glyph's box reaches over and under its origin, in sizes.
ASCENT, DESCENT = 0.8, -0.2
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(m: tuple, n: tuple) -> tuple:
    """The matrix that does m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


def moved(x: float, y: float, m: tuple) -> tuple:
    """The matrix that shifts by (x, y), then does m."""
    return (*m[:4], x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5])


class TextState:
    """What text operators change. It lasts from one text object to the next; q and Q keep the transformation alone."""

    def __init__(self):
        self.font: Font | None = None
        self.size = self.char_space = self.word_space = self.leading = self.rise = 0.0
        self.stretch = 1.0
        self.text = self.line = self.ctm = IDENTITY
        self.saved: list[tuple] = []

    def next_line(self, x: float, y: float) -> None:
        self.line = moved(x, y, self.line)
        self.text = self.line


def glyphs(content: bytes, font_of: Callable[[str], Font | None], height: float) -> Iterator[tuple]:
    """(code, text, x0, y0, x1, y1, ox, oy, size) of each glyph in order of showing, y down from the page's top.

    Operators without a part in text are passed over with their operands. Of surplus operands the first count. Missing ones
    count as 0; a matrix of no operands is all zeros, one of a single number a turn by so many degrees, one of two a scaling, and
    one of three to five Malformed. Without a font nothing shows and nothing moves. Stray delimiters are passed over.
    """
    state, scanner, operands = TextState(), Scanner(content), []

    def num(k: int) -> float:
        v = operands[k] if k < len(operands) else 0
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0

    def matrix() -> tuple:
        if len(operands) == 1:
            turn = math.radians(num(0))
            return math.cos(turn), math.sin(turn), -math.sin(turn), math.cos(turn), 0.0, 0.0
        if len(operands) == 2:
            return num(0), 0.0, 0.0, num(1), 0.0, 0.0
        if 2 < len(operands) < 6:
            raise Malformed(f"a matrix of {len(operands)} numbers")
        return tuple(map(num, range(6)))

    def shown(data):
        if not isinstance(data, bytes) or state.font is None:
            return
        size, stretch, rise, ctm = state.size, state.stretch, state.rise, state.ctm
        for code, text, width in state.font.decode(data):
            a, b, c, d, e, f = product((size * stretch, 0.0, 0.0, size, 0.0, rise), product(state.text, ctm))
            px, py = DESCENT * c + e, DESCENT * d + f
            qx, qy = width * a + ASCENT * c + e, width * b + ASCENT * d + f
            yield code, text, min(px, qx), height - max(py, qy), max(px, qx), height - min(py, qy), e, height - f, size
            step = (width * size + state.char_space + (state.word_space if code == 32 else 0.0)) * stretch
            state.text = moved(step, 0.0, state.text)

    while True:
        token = scanner.next()
        if not isinstance(token, Word):
            operands.append(token)
            continue
        if token == END:
            return
        first = operands[0] if operands else None
        if token == b"q":
            state.saved.append(state.ctm)
        elif token == b"Q":
            state.ctm = state.saved.pop() if state.saved else IDENTITY
        elif token == b"cm":
            state.ctm = product(matrix(), state.ctm)
        elif token == b"BT":
            state.text = state.line = IDENTITY
        elif token == b"Tf":
            state.font, state.size = (font_of(str(first)) if isinstance(first, Name) else None), num(1)
        elif token == b"Td":
            state.next_line(num(0), num(1))
        elif token == b"TD":
            state.leading = -num(1)
            state.next_line(num(0), num(1))
        elif token == b"Tm":
            state.text = state.line = matrix()
        elif token == b"T*":
            state.next_line(0.0, -state.leading)
        elif token == b"Tc":
            state.char_space = num(0)
        elif token == b"Tw":
            state.word_space = num(0)
        elif token == b"Tz":
            state.stretch = num(0) / 100.0
        elif token == b"TL":
            state.leading = num(0)
        elif token == b"Ts":
            state.rise = num(0)
        elif token == b"Tj":
            yield from shown(first)
        elif token == b"TJ":
            for item in first if isinstance(first, list) else ():
                if isinstance(item, bytes):
                    yield from shown(item)
                elif isinstance(item, (int, float)):
                    state.text = moved(-item / 1000.0 * state.size * state.stretch, 0.0, state.text)
        elif token == b"'":
            state.next_line(0.0, -state.leading)
            yield from shown(first)
        elif token == b'"':
            state.word_space, state.char_space = num(0), num(1)
            state.next_line(0.0, -state.leading)
            yield from shown(operands[2] if len(operands) > 2 else None)
        elif token == b"ID":  # the data of an inline image end with EI between blanks
            stop = scanner.data.find(b"EI", scanner.pos)
            scanner.pos = len(scanner.data) if stop < 0 else stop + 2
        operands = []
