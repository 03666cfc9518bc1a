"""Objects of PDF syntax: reading them from bytes with one compiled pattern, and writing them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from folia.errors import Malformed

#: How deep arrays and dictionaries may nest.
DEPTH = 200


class Name(str):
    """A PDF name; equal to the string of its text."""

    __slots__ = ()

    def __repr__(self) -> str:
        return f"/{str(self)}"


class Ref(NamedTuple):
    num: int
    gen: int


class Word(bytes):
    """An operator or keyword."""

    __slots__ = ()


@dataclass
class Stream:
    dict: dict
    raw: bytes
    note: dict = field(default_factory=dict)


END = Word(b"")
_SKIP = rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*"
_TOKEN = re.compile(
    _SKIP
    + rb"(?:(?P<ref>(?P<num>\d{1,10})[\x00\t\n\x0c\r ]+(?P<gen>\d{1,5})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%]))"
    + rb"|(?P<real>[+-]*\d*\.\d*(?![^\x00\t\n\x0c\r ()<>\[\]{}/%]))|(?P<int>[+-]*\d+(?![^\x00\t\n\x0c\r ()<>\[\]{}/%]))"
    + rb"|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<dict><<)|(?P<enddict>>>)|<(?P<hex>[^>]*)>?"
    + rb"|(?P<text>\()|(?P<list>\[)|(?P<endlist>\])|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<stray>.))",
    re.S,
)
#: All numbers of an array of whole numbers alone, up to its end.
_WHOLE = re.compile(rb"((?:[\t\n\x0c\r ]*+[+-]?\d++(?=[\t\n\x0c\r \]]))++)[\t\n\x0c\r ]*+\]")
_STREAM = re.compile(_SKIP + rb"stream(\r\n|\n|\r)?")
_PART = re.compile(rb"[^()\\\r]+|\\\r\n|\\[0-7]{1,3}|\\.|\r\n?|[()]|\\", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c", b"\n": b"", b"\r": b"", b"\r\n": b""}
_CONSTANT = {b"true": True, b"false": False, b"null": None}


class Scanner:
    """Reads objects from data at pos. Every call moves on by a byte at least, or ends."""

    def __init__(self, data: bytes, pos: int = 0, decrypt: Callable[[bytes], bytes] | None = None):
        self.data, self.pos, self.decrypt = data, pos, decrypt

    def next(self, depth: int = 0):
        """The next object, a Word (operators and keywords, also b']' and b'>>'), or END."""
        if depth > DEPTH:
            raise Malformed("nested too deep")
        m = _TOKEN.match(self.data, self.pos)
        if m is None:
            self.pos = len(self.data)
            return END
        self.pos, kind = m.end(), m.lastgroup
        if kind == "ref":
            return Ref(int(m["num"]), int(m["gen"]))
        if kind == "int":
            return _signed(m["int"], int)
        if kind == "real":
            return _signed(m["real"], lambda x: float(x) if x != b"." else 0.0)
        if kind == "name":
            return _read_name(m["name"])
        if kind == "hex":
            return self._plain(unhex(m["hex"]))
        if kind == "text":
            return self._plain(self._literal())
        if kind == "list":
            if m := _WHOLE.match(self.data, self.pos):
                self.pos = m.end()
                return list(map(int, m[1].split()))
            out = []
            while True:
                item = self.next(depth + 1)
                if isinstance(item, Word):
                    if item in (b"]", b"", b"endobj", b"stream"):
                        return out
                    continue
                out.append(item)
        if kind == "dict":
            return self._dict(depth)
        if kind == "word":
            word = m["word"]
            return _CONSTANT[word] if word in _CONSTANT else Word(word)
        return Word(m[kind])

    def _dict(self, depth: int) -> dict:
        out, key = {}, None
        while True:
            item = self.next(depth + 1)
            if isinstance(item, Word):
                if item in (b">>", b"", b"endobj"):
                    return out
                if item == b"stream":
                    self.pos -= 6
                    return out
                continue
            if key is None:
                key = str(item) if isinstance(item, Name) else None
            else:
                out[key] = item
                key = None

    def _plain(self, data: bytes) -> bytes:
        return self.decrypt(data) if self.decrypt else data

    def _literal(self) -> bytes:
        out, level = [], 1
        for m in _PART.finditer(self.data, self.pos):
            part = m.group()
            if part == b"(":
                level += 1
            elif part == b")":
                level -= 1
                if not level:
                    self.pos = m.end()
                    return b"".join(out)
            elif part[:1] == b"\r":
                part = b"\n"
            elif part[:1] == b"\\":
                rest = part[1:]
                part = bytes([int(rest, 8) & 255]) if rest[:1].isdigit() and rest[:1] < b"8" else _ESCAPED.get(rest, rest)
            out.append(part)
        self.pos = len(self.data)
        return b"".join(out)

    def indirect(self, resolve: Callable | None = None):
        """The object of 'n g obj' at pos, a Stream where one follows its dictionary."""
        value = self.next()
        if not isinstance(value, dict):
            return None if isinstance(value, Word) else value
        m = _STREAM.match(self.data, self.pos)
        return Stream(value, self._extent(m.end(), value.get("Length"), resolve)) if m else value

    def _extent(self, start: int, length, resolve) -> bytes:
        """The stream's bytes: /Length counts if endstream follows close by; otherwise all up to endstream but one line end."""
        if isinstance(length, Ref):
            length = resolve(length) if resolve else None
        if isinstance(length, int) and 0 <= length and b"endstream" in self.data[start + length : start + length + 29]:
            return self.data[start : start + length]
        stop = self.data.find(b"endstream", start)
        stop = len(self.data) if stop < 0 else stop
        raw = self.data[start:stop]
        return raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw


@lru_cache(4096)
def _read_name(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("utf-8", "surrogateescape"))


@lru_cache(4096)
def _written_name(name: str) -> bytes:
    return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m.group()[0], name.encode("utf-8", "surrogateescape"))


def _signed(text: bytes, kind):
    body = text.lstrip(b"+-")
    value = kind(body)
    return -value if text[: len(text) - len(body)].count(b"-") % 2 else value


def unhex(text: bytes) -> bytes:
    """Hexadecimal digits to bytes; anything else is skipped, and a last single digit is filled up with 0."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", text)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def number(value: float, places: int = 6) -> str:
    """A number without needless zeros."""
    if float(value).is_integer():
        return str(int(value))
    text = f"{value:.{places}f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def literal(data: bytes) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", data) + b")"


def serialize(value) -> bytes:
    """A value in PDF syntax: printable strings in parentheses, others as hexadecimal digits."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, (int, float)):
        return number(value).encode()
    if isinstance(value, Name):
        return _written_name(value)
    if isinstance(value, bytes):
        return literal(value) if re.fullmatch(rb"[ -~\n\t]*", value) else b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, (list, tuple)):
        if set(map(type, value)) == {int}:
            return b"[" + " ".join(map(str, value)).encode() + b"]"
        return b"[" + b" ".join(map(serialize, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(_written_name(k) + b" " + serialize(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialize(value.dict | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise TypeError(f"no PDF form for {type(value).__name__}")
