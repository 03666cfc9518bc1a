"""Images: what they are, standalone files of them, and PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from folia.errors import FoliaError, Malformed
from folia.pdf.syntax import Name, Stream

#: Fixed values of PNG: the colour type of 1 to 4 interleaved channels, and the channels of a colour type.
COLOR_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_SPACES = {"G": "DeviceGray", "CalGray": "DeviceGray", "RGB": "DeviceRGB", "CalRGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
_PARTS = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "Indexed": 1}


def png(width: int, height: int, data: bytes, color_type: int = 2, depth: int = 8) -> bytes:
    """A PNG file of rows of samples, unfiltered; short data are filled up with zeros."""
    row = (width * CHANNELS[color_type] * depth + 7) // 8
    rows = np.zeros((height, row + 1), dtype=np.uint8)
    flat = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), dtype=np.uint8)
    rows[:, 1:] = flat.reshape(height, row)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, depth, color_type, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def unpng(data: bytes) -> tuple[int, int, int, int, bytes]:
    """(width, height, colour type, depth, samples) of an unfiltered PNG file."""
    at, body = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height, depth, color = struct.unpack(">IIBB", data[at + 8 : at + 18])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    row = (width * CHANNELS[color] * depth + 7) // 8
    flat = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, row + 1)
    return width, height, color, depth, flat[:, 1:].tobytes()


def cmyk_to_rgb(data: bytes) -> bytes:
    c = np.frombuffer(data[: len(data) // 4 * 4], dtype=np.uint8).reshape(-1, 4).astype(np.uint32)
    return ((255 - c[:, :3]) * (255 - c[:, 3:]) // 255).astype(np.uint8).tobytes()


class Image:
    """One image object of a document."""

    def __init__(self, stream: Stream, resolve, decoded):
        self.stream, self.resolve, self.decoded = stream, resolve, decoded
        spec = stream.dict

        def whole(*keys, default=0):
            for k in keys:
                v = resolve(spec.get(k))
                if isinstance(v, (int, float)):
                    return int(v)
            return default

        self.width, self.height, self.bpc = whole("Width", "W"), whole("Height", "H"), whole("BitsPerComponent", "BPC", default=8)
        self.space = self.label(spec.get("ColorSpace", spec.get("CS")))
        f = resolve(spec.get("Filter", spec.get("F")))
        f = resolve(f[-1]) if isinstance(f, list) and f else f
        self.filter = str(f) if isinstance(f, Name) else None

    def label(self, space) -> str:
        space = self.resolve(space)
        if isinstance(space, Name):
            return _SPACES.get(space, str(space))
        if not isinstance(space, list) or not space:
            return "DeviceGray"
        head = str(self.resolve(space[0]))
        if head == "ICCBased":
            profile = self.resolve(space[1]) if len(space) > 1 else None
            n = self.resolve(profile.dict.get("N")) if isinstance(profile, Stream) else None
            return {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB")
        return "DeviceRGB" if head == "Lab" else _SPACES.get(head, head)

    def info(self) -> dict:
        return {"width": self.width, "height": self.height, "bpc": self.bpc, "colorspace": self.space, "filter": self.filter}

    def extract(self) -> dict:
        """The image as a file: jpg and jp2 data as they are, other images as png; data that can't be decoded as bin."""
        base = {"width": self.width, "height": self.height, "colorspace": self.space, "bpc": self.bpc}
        if self.filter in ("DCTDecode", "JPXDecode"):
            return base | {"ext": "jpg" if self.filter == "DCTDecode" else "jp2", "image": self.stream.raw}
        try:
            data = self.decoded(self.stream)
        except Malformed:
            return base | {"ext": "bin", "image": self.stream.raw}
        if self.space == "Indexed":
            return base | {"ext": "png", "image": png(self.width, self.height, self._indexed(data))}
        if self.space == "DeviceCMYK":
            return base | {"ext": "png", "image": png(self.width, self.height, cmyk_to_rgb(data))}
        return base | {"ext": "png", "image": png(self.width, self.height, data, 2 if self.space == "DeviceRGB" else 0, self.bpc)}

    def _indexed(self, data: bytes) -> bytes:
        space = self.resolve(self.stream.dict.get("ColorSpace", self.stream.dict.get("CS")))
        base = self.label(space[1]) if len(space) > 1 else "DeviceRGB"
        table = self.resolve(space[3]) if len(space) > 3 else b""
        table = self.decoded(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b""
        parts = _PARTS.get(base, 3)
        colors = np.frombuffer(table.ljust(256 * parts, b"\0")[: 256 * parts], dtype=np.uint8).reshape(256, parts)
        if base == "DeviceCMYK":
            colors = np.frombuffer(cmyk_to_rgb(colors.tobytes()), dtype=np.uint8).reshape(256, 3)
        elif parts == 1:
            colors = np.repeat(colors, 3, axis=1)
        n = self.width * self.height
        return colors[np.frombuffer(data[:n].ljust(n, b"\0"), dtype=np.uint8)].tobytes()


class Pixmap:
    """Interleaved 8-bit samples: gray, gray with alpha, RGB or RGB with alpha."""

    def __init__(self, width: int, height: int, n: int, samples: bytes, xres: int = 72, yres: int = 72):
        self.width, self.height, self.n, self.samples, self.xres, self.yres = width, height, n, bytes(samples), xres, yres

    @property
    def stride(self) -> int:
        return self.width * self.n

    @property
    def alpha(self) -> bool:
        return self.n in (2, 4)

    @property
    def colorspace(self) -> str:
        return "DeviceGray" if self.n <= 2 else "DeviceRGB"

    def pixel(self, x: int, y: int) -> tuple[int, ...]:
        if not (0 <= x < self.width and 0 <= y < self.height):
            raise FoliaError(f"no pixel ({x}, {y})")
        at = y * self.stride + x * self.n
        return tuple(self.samples[at : at + self.n])

    def to_png(self) -> bytes:
        if self.n not in COLOR_TYPES:
            raise FoliaError(f"no PNG of {self.n} channels")
        return png(self.width, self.height, self.samples, COLOR_TYPES[self.n])

    to_bytes = to_png

    def save(self, path: str) -> None:
        if not str(path).lower().endswith(".png"):
            raise FoliaError("only .png files are written")
        with open(path, "wb") as f:
            f.write(self.to_png())

    def __str__(self) -> str:
        return f"Pixmap({self.width}x{self.height}, {self.colorspace}, {self.n} channels)"
