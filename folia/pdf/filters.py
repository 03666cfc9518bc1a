"""Stream filters: Flate with predictors, ASCIIHex and ASCII85."""

from __future__ import annotations

import re
import zlib

import numpy as np

from folia.errors import Malformed
from folia.pdf.syntax import unhex

_ODD85 = re.compile(rb"[^!-uz]")
_NAMES = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode"}


def inflate(data: bytes) -> bytes:
    """zlib data, or raw deflate data, whole to their end marks; bytes after them are passed over."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data) + d.flush()
        except zlib.error:
            continue
        if d.eof:
            return out
    raise Malformed("damaged Flate data")


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undoes PNG prediction (10 and up), each row by its own tag; other predictors leave the data as it is."""
    if predictor < 10:
        return data
    step = max(1, colors * bits // 8)
    width = (colors * bits * columns + 7) // 8
    rows = -(-len(data) // (width + 1))
    whole = np.zeros((rows, width + 1), dtype=np.uint8)
    whole.ravel()[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    kinds, out = whole[:, 0].copy(), whole[:, 1:]
    sums = np.flatnonzero(kinds == 1)  # rows by their left neighbours alone, all at once
    for k in range(min(step, width)):
        out[sums, k::step] = np.cumsum(out[sums, k::step], axis=1, dtype=np.uint64).astype(np.uint8)
    for at in np.flatnonzero((kinds > 1) & (kinds < 5)).tolist():  # rows that need the one above, in order
        above = out[at - 1] if at else np.zeros(width, dtype=np.uint8)
        if kinds[at] == 2:
            out[at] += above
            continue
        line, up = out[at].tolist(), above.tolist()
        for i, x in enumerate(line):
            left, corner = (line[i - step], up[i - step]) if i >= step else (0, 0)
            line[i] = (x + ((left + up[i]) // 2 if kinds[at] == 3 else _nearest(left, up[i], corner))) & 255
        out[at] = line
    return out.tobytes()


def _nearest(left: int, up: int, corner: int) -> int:
    """Of the three neighbours the one nearest to left + up - corner; left, then up wins a tie."""
    target = left + up - corner
    return min((left, up, corner), key=lambda v: abs(target - v))


def unbase85(data: bytes) -> bytes:
    text = re.sub(rb"\s", b"", data)
    text = text.split(b"~>")[0].removeprefix(b"<~")
    parts = text.split(b"z")
    if not _ODD85.search(text) and all(len(x) % 5 == 0 for x in parts[:-1]):  # only digits, and z between whole groups
        text = b"!!!!!".join(parts)
        short = -len(text) % 5
        digits = np.frombuffer(text + b"u" * short, dtype=np.uint8).reshape(-1, 5).astype(np.uint64) - np.uint64(0x21)
        found = (digits @ np.array([85**4, 85**3, 85**2, 85, 1], dtype=np.uint64)).astype(np.uint32).astype(">u4").tobytes()
        return found[: len(found) - (short if short < 4 else 4)]
    out, group = bytearray(), []
    for c in text:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += (sum(d * 85 ** (4 - k) for k, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        short = len(group) - 1
        filled = group + [84] * (5 - len(group))
        out += (sum(d * 85 ** (4 - k) for k, d in enumerate(filled)) & 0xFFFFFFFF).to_bytes(4, "big")[:short]
    return bytes(out)


def decode(dict_: dict, raw: bytes, resolve=lambda v: v) -> bytes:
    """raw through the filters of dict_, in order, each with its own parameters."""

    def listed(value):
        value = resolve(value)
        return value if isinstance(value, list) else [] if value is None else [value]

    params = listed(dict_.get("DecodeParms", dict_.get("DP")))
    for k, name in enumerate(listed(dict_.get("Filter", dict_.get("F")))):
        name = _NAMES.get(str(resolve(name)), str(resolve(name)))
        own = resolve(params[k]) if k < len(params) else None
        own = own if isinstance(own, dict) else {}

        def value(key, default):
            v = resolve(own.get(key, default))
            return int(v) if isinstance(v, (int, float)) else default

        if name == "FlateDecode":
            raw = unpredict(inflate(raw), value("Predictor", 1), value("Colors", 1), value("BitsPerComponent", 8), value("Columns", 1))
        elif name == "ASCIIHexDecode":
            raw = unhex(raw.split(b">")[0])
        elif name == "ASCII85Decode":
            raw = unbase85(raw)
        else:
            raise Malformed(f"unsupported stream filter: {name}")
    return raw
