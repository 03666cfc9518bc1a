"""Splitting a text into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import re

import public_tokenizers
import regex

_WHOLE = regex.compile(public_tokenizers.PATTERN)
#: Over these characters the same split needs no Unicode tables: ASCII and the letters U+00C0 to U+024F, which holds two signs.
_PLAIN = re.compile("[\t\n\r -~\u00c0-\u024f]*")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


def pieces(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN, which leave nothing out."""
    return (_QUICK if plain(text) else _WHOLE).findall(text)


class Memo(dict):
    """What make gives for a piece, kept for short pieces. When most are held they become the older generation and the one before goes, so pieces in use stay."""

    def __init__(self, make, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, piece):
        made = self.older.get(piece)
        if made is None:
            made = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = made
        return made
