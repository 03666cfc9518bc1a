"""Fonts: codes to text and to widths."""

from __future__ import annotations

import re

from folia.errors import Malformed
from folia.pdf.syntax import END, Name, Scanner, Stream, Word

#: Short names of the standard fonts.
ALIASES = {
    "helv": "Helvetica",
    "heit": "Helvetica-Oblique",
    "hebo": "Helvetica-Bold",
    "hebi": "Helvetica-BoldOblique",
    "cour": "Courier",
    "cobo": "Courier-Bold",
    "coit": "Courier-Oblique",
    "cobi": "Courier-BoldOblique",
    "tiro": "Times-Roman",
    "tibo": "Times-Bold",
    "tiit": "Times-Italic",
    "tibi": "Times-BoldItalic",
    "symb": "Symbol",
    "zadb": "ZapfDingbats",
}
#: Widths of the characters 32 to 126 in thousandths, from the public Adobe font metrics.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556,
    556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
HELVETICA_BOLD = [
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611,
    611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
]
#: Widths of characters outside the tables, and of a composite font's codes that it doesn't list.
OTHER, COURIER, UNLISTED = 556, 600, 500

#: Names of glyphs from the public Adobe glyph list.
GLYPHS = {
    "space": 0x20, "exclam": 0x21, "quotedbl": 0x22, "numbersign": 0x23, "dollar": 0x24, "percent": 0x25, "ampersand": 0x26,
    "quotesingle": 0x27, "parenleft": 0x28, "parenright": 0x29, "asterisk": 0x2A, "plus": 0x2B, "comma": 0x2C, "hyphen": 0x2D,
    "period": 0x2E, "slash": 0x2F, "colon": 0x3A, "semicolon": 0x3B, "less": 0x3C, "equal": 0x3D, "greater": 0x3E,
    "question": 0x3F, "at": 0x40, "bracketleft": 0x5B, "backslash": 0x5C, "bracketright": 0x5D, "asciicircum": 0x5E,
    "underscore": 0x5F, "grave": 0x60, "braceleft": 0x7B, "bar": 0x7C, "braceright": 0x7D, "asciitilde": 0x7E,
    "quoteleft": 0x2018, "quoteright": 0x2019, "quotedblleft": 0x201C, "quotedblright": 0x201D, "bullet": 0x2022,
    "endash": 0x2013, "emdash": 0x2014, "ellipsis": 0x2026, "dagger": 0x2020, "daggerdbl": 0x2021, "perthousand": 0x2030,
    "guilsinglleft": 0x2039, "guilsinglright": 0x203A, "trademark": 0x2122, "fi": 0xFB01, "fl": 0xFB02, "florin": 0x0192,
    "minus": 0x2212, "fraction": 0x2044, "Euro": 0x20AC, "cent": 0xA2, "sterling": 0xA3, "yen": 0xA5, "copyright": 0xA9,
    "registered": 0xAE, "degree": 0xB0, "plusminus": 0xB1, "paragraph": 0xB6, "section": 0xA7, "middot": 0xB7,
    "multiply": 0xD7, "divide": 0xF7, "adieresis": 0xE4, "odieresis": 0xF6, "udieresis": 0xFC, "Adieresis": 0xC4,
    "Odieresis": 0xD6, "Udieresis": 0xDC, "germandbls": 0xDF, "eacute": 0xE9, "egrave": 0xE8, "agrave": 0xE0,
    "ccedilla": 0xE7, "ntilde": 0xF1, "aacute": 0xE1, "iacute": 0xED, "oacute": 0xF3, "uacute": 0xFA, "ocircumflex": 0xF4,
    "acircumflex": 0xE2,
}
#: Names of digits are words in the public list.
GLYPHS |= {word: 0x30 + k for k, word in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))}

CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
UNKNOWN = "�"


def standard_name(name: str) -> str:
    return ALIASES.get(name.lower(), name)


def char_width(name: str, code: int) -> int:
    """The width of a character in a standard font, in thousandths."""
    base = standard_name(name)
    if base.startswith("Courier"):
        return COURIER
    table = HELVETICA_BOLD if base.startswith("Helvetica-Bold") else HELVETICA
    return table[code - 32] if 32 <= code <= 126 else OTHER


def text_width(name: str, text: str, size: float) -> float:
    return sum(char_width(name, ord(c)) for c in text) / 1000.0 * size


def is_bold(name: str) -> bool:
    return "Bold" in standard_name(name)


def glyph_char(name: str) -> str | None:
    """The character of a glyph name: listed, a single character, uniXXXX or uXXXX to uXXXXXX."""
    code = GLYPHS.get(name)
    if code is None and len(name) == 1:
        return name
    if code is None and (m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name)):
        code = int(m[1] or m[2], 16)
    return None if code is None or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


class CMap:
    """A ToUnicode map: code to text."""

    def __init__(self, data: bytes = b""):
        self.code_bytes, self.single, self.ranges = 1, {}, []
        scanner, operands = Scanner(data), []
        while (token := scanner.next()) != END or not isinstance(token, Word):
            if not isinstance(token, Word):
                operands.append(token)
                continue
            if token == b"endcodespacerange":
                self.code_bytes = max([len(x) for x in operands if isinstance(x, bytes)] or [1])
            elif token == b"endbfchar":
                for code, target in zip(operands[::2], operands[1::2]):
                    if isinstance(code, bytes):
                        self.single[int.from_bytes(code, "big")] = self._target(target)
            elif token == b"endbfrange":
                for low, high, target in zip(operands[::3], operands[1::3], operands[2::3]):
                    if isinstance(low, bytes) and isinstance(high, bytes):
                        self.ranges.append((int.from_bytes(low, "big"), int.from_bytes(high, "big"), target))
            operands = []

    @staticmethod
    def _target(value) -> str:
        if isinstance(value, Name):
            return glyph_char(value) or UNKNOWN
        return value.decode("utf-16-be", "replace") if isinstance(value, bytes) else ""

    def lookup(self, code: int) -> str | None:
        """Single codes come first; in a range the last character counts up."""
        if code in self.single:
            return self.single[code]
        for low, high, target in self.ranges:
            if low <= code <= high:
                if isinstance(target, list):
                    found = self._target(target[code - low]) if code - low < len(target) else None
                else:
                    text = self._target(target)
                    found = text[:-1] + chr(min(ord(text[-1]) + code - low, 0x10FFFF)) if text else None
                if found is not None:
                    self.single[code] = found
                    return found
        return None


class Font:
    """How one font resource decodes shown strings."""

    def __init__(self, spec: dict, resolve, decoded):
        self.composite = resolve(spec.get("Subtype")) == "Type0"
        self.base = re.sub(r"^[A-Z]{6}\+", "", str(resolve(spec.get("BaseFont")) or ""))
        self.cmap = None
        stream = resolve(spec.get("ToUnicode"))
        if isinstance(stream, Stream):
            try:
                self.cmap = CMap(decoded(stream))
            except Malformed:
                self.cmap = None
        self.codec, self.different = "latin-1", {}
        encoding = resolve(spec.get("Encoding"))
        if isinstance(encoding, dict):
            self.codec, code = CODECS.get(resolve(encoding.get("BaseEncoding")), "latin-1"), 0
            for item in resolve(encoding.get("Differences")) or []:
                item = resolve(item)
                if isinstance(item, Name):
                    char = glyph_char(item)
                    if char is not None:
                        self.different[code] = char
                    code += 1
                elif isinstance(item, (int, float)):
                    code = int(item)
        elif isinstance(encoding, Name):
            self.codec = CODECS.get(encoding, "latin-1")
        self.widths, self.unlisted = {}, UNLISTED
        if self.composite:
            below = resolve(spec.get("DescendantFonts"))
            below = resolve(below[0]) if isinstance(below, list) and below else None
            if isinstance(below, dict):
                unlisted = resolve(below.get("DW"))
                self.unlisted = unlisted if isinstance(unlisted, (int, float)) else UNLISTED
                self._listed(resolve(below.get("W")), resolve)
        else:
            first = resolve(spec.get("FirstChar"))
            first = int(first) if isinstance(first, (int, float)) else 0
            for k, w in enumerate(resolve(spec.get("Widths")) or []):
                w = resolve(w)
                if isinstance(w, (int, float)):
                    self.widths[first + k] = w
        self._chars: dict[int, tuple[str, float]] = {}

    def _listed(self, items, resolve) -> None:
        """Widths of a composite font: 'c [w ...]' and 'first last w'."""
        items, k = [resolve(x) for x in items] if isinstance(items, list) else [], 0
        while k + 1 < len(items):
            if isinstance(items[k + 1], list):
                for j, w in enumerate(items[k + 1]):
                    self.widths[int(items[k]) + j] = resolve(w)
                k += 2
            elif k + 2 < len(items):
                for code in range(int(items[k]), min(int(items[k + 1]), 0xFFFF) + 1):  # codes have two bytes at most
                    self.widths[code] = items[k + 2]
                k += 3
            else:
                break

    def _char(self, code: int) -> tuple[str, float]:
        found = self._chars.get(code)
        if found is None:
            text = self.cmap.lookup(code) if self.cmap else None
            if text is None and not self.composite:
                text = self.different.get(code) or bytes([code & 255]).decode(self.codec, "replace")
            width = self.widths.get(code)
            if width is None:
                width = self.unlisted if self.composite else char_width(self.base, code)
            found = self._chars[code] = (UNKNOWN if text is None else text, width / 1000.0)
        return found

    def decode(self, data: bytes):
        """(code, text, width) of each code of a shown string; composite fonts have codes of two bytes unless their map says one."""
        if self.composite and not (self.cmap and self.cmap.code_bytes == 1):
            codes = [int.from_bytes((data[i : i + 2] + b"\0")[:2], "big") for i in range(0, len(data), 2)]
        else:
            codes = data
        return [(code, *self._char(code)) for code in codes]
