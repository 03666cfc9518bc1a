"""A PDF document as an object graph: objects, pages, outline, links, annotations, images."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

from folia.errors import Encrypted, FileData, Malformed, PageNotFound
from folia.pdf import filters
from folia.pdf.content import glyphs
from folia.pdf.crypto import Security
from folia.pdf.fonts import Font
from folia.pdf.images import Image
from folia.pdf.syntax import Name, Ref, Scanner, Stream, serialize

#: Bytes in which the header must lie, and the box of a page that has none.
HEADER_BYTES = 1024
LETTER = (0.0, 0.0, 612.0, 792.0)
#: Keys of the information dictionary by the name of the metadata.
INFO_KEYS = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creationDate": "CreationDate", "modDate": "ModDate"}
INHERITED = ("MediaBox", "CropBox", "Rotate", "Resources")
NOWHERE = {"kind": "none", "page": None, "to": None, "uri": None}
#: The start of a name that may be XRef or ObjStm with escaped letters.
_ESCAPED = re.compile(rb"/[A-Za-z]{0,5}#[0-9A-Fa-f]{2}")
_OBJECT = re.compile(rb"(?<=[\x00\t\n\x0c\r ])obj(?![A-Za-z])")
_BLANKS = b"\x00\t\n\x0c\r "


def text_string(data: bytes | None) -> str | None:
    """UTF-16 where a byte order mark says so, else Latin-1."""
    if not isinstance(data, bytes):
        return None
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _number_before(data: bytes, stop: int, most: int) -> tuple[int, int] | None:
    """Where the number lies that blanks alone part from stop; None where there is none of at most so many digits."""
    end = stop
    while end and data[end - 1] in _BLANKS:
        end -= 1
    start = end
    while start and end - start <= most and 48 <= data[start - 1] <= 57:
        start -= 1
    return (start, end) if end < stop and 0 < end - start <= most else None


def definitions(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(number, generation, start, end) of each 'n g obj'. They are found by their last word, so that long runs of numbers cost nothing."""
    for m in _OBJECT.finditer(data):
        gen = _number_before(data, m.start(), 5)
        num = gen and _number_before(data, gen[0], 10)
        if num:
            yield int(data[slice(*num)]), int(data[slice(*gen)]), num[0], m.end()


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


class PdfFile:
    """The objects of a file. They are found by scanning, so damaged cross references don't matter; later definitions win."""

    def __init__(self, data: bytes):
        head = re.search(rb"%PDF-(\d+\.\d+)", data[:HEADER_BYTES])
        if not head:
            raise FileData("no PDF header")
        self.data, self.version = data, head[1].decode()
        self.places: dict[int, tuple[int, int, int]] = {}
        for num, gen, start, end in definitions(data):
            self.places[num] = (gen, start, end)
        self.packed: dict[int, object] = {}
        self._cache: dict[int, object] = {}
        self._decoded: dict[int, bytes] = {}
        self._busy: set[int] = set()
        self.security: Security | None = None
        self.trailer: dict = {}
        for m in re.finditer(rb"trailer", data):
            try:
                found = Scanner(data, m.end()).next()
            except Malformed:
                continue
            if isinstance(found, dict):
                self.trailer.update(found)
        streams = self._streams() if b"/ObjStm" in data or b"/XRef" in data or _ESCAPED.search(data) else []
        for n in streams:
            if isinstance(s := self.object(n), Stream) and self.resolve(s.dict.get("Type")) == "XRef":
                self.trailer.update(s.dict)
        self._secure()
        for n in streams:
            if isinstance(s := self.object(n), Stream) and self.resolve(s.dict.get("Type")) == "ObjStm":
                self._unpack(s)
        self.packed = {n: v for n, v in self.packed.items() if n not in self.places}

    def _streams(self) -> list[int]:
        """The numbers of the objects that may be streams: what they are their parsed dictionaries tell, however long."""
        starts = sorted((start, n) for n, (_, start, _) in self.places.items())
        owners = {bisect_right(starts, (m.start(), 1 << 62)) for m in re.finditer(rb"stream", self.data)}
        found = {starts[k - 1][1] for k in owners if k}
        return [n for n in self.places if n in found]

    def _secure(self) -> None:
        own = self.trailer.get("Encrypt")
        spec = self.resolve(own)
        if not isinstance(spec, dict):
            return
        ids = self.resolve(self.trailer.get("ID"))
        first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
        self.security = Security(spec, first if isinstance(first, bytes) else b"", self.resolve)
        kept = own.num if isinstance(own, Ref) else None
        self._plain = {kept} | {n for n, v in self._cache.items() if isinstance(v, Stream) and v.dict.get("Type") == "XRef"}
        self._cache = {n: v for n, v in self._cache.items() if n in self._plain}

    def _unpack(self, stream: Stream) -> None:
        try:
            data = self.decoded(stream)
        except Malformed:
            return
        n, first = self.resolve(stream.dict.get("N")), self.resolve(stream.dict.get("First"))
        if not (is_number(n) and is_number(first)):
            return
        scanner = Scanner(data)
        numbers = [scanner.next() for _ in range(2 * min(int(n), len(data)))]
        for num, at in zip(numbers[::2], numbers[1::2]):
            if isinstance(num, int) and isinstance(at, int):
                self.packed[num] = Scanner(data, int(first) + at).next()

    def object(self, num: int):
        """The object of that number; None where there is none or it refers to itself."""
        if num in self._cache:
            return self._cache[num]
        if num in self._busy:
            return None
        if num not in self.places:
            return self.packed.get(num)
        gen, start, end = self.places[num]
        self._busy.add(num)
        try:
            secure = self.security if self.security and num not in self._plain else None
            scanner = Scanner(self.data, end, (lambda s: secure.decrypt(s, num, gen)) if secure else None)
            value = scanner.indirect(self.resolve)
            if isinstance(value, Stream):
                value.note["num"] = num
                if secure and self.resolve(value.dict.get("Type")) != "XRef":
                    value.raw = secure.decrypt(value.raw, num, gen)
        except Malformed:
            value = None
        finally:
            self._busy.discard(num)
        self._cache[num] = value
        return value

    def resolve(self, value):
        """What a value refers to, through any number of references; None where they lead in a circle."""
        if not isinstance(value, Ref):
            return value
        seen: set[int] = set()
        while isinstance(value, Ref):
            if value.num in seen:
                return None
            seen.add(value.num)
            value = self.object(value.num)
        return value

    def decoded(self, stream: Stream) -> bytes:
        num = stream.note.get("num")
        if num not in self._decoded:
            data = filters.decode(stream.dict, stream.raw, self.resolve)
            if num is None:
                return data
            self._decoded[num] = data
        return self._decoded[num]

    @property
    def catalog(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        if isinstance(root, dict):
            return root
        return next((v for n in self.numbers() if isinstance(v := self.object(n), dict) and self.resolve(v.get("Type")) == "Catalog"), {})

    @property
    def info(self) -> dict | None:
        found = self.resolve(self.trailer.get("Info"))
        return found if isinstance(found, dict) else None

    def numbers(self) -> list[int]:
        return sorted({*self.places, *self.packed})

    def max_number(self) -> int:
        return max(self.numbers(), default=0)

    def references(self, value) -> Iterator[int]:
        """The numbers of the objects that a value refers to, in order."""
        stack = [value]
        while stack:
            value = stack.pop()
            if isinstance(value, Ref):
                yield value.num
            inner = value.dict.values() if isinstance(value, Stream) else value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
            stack.extend(reversed(list(inner)))

    def rows(self) -> Iterator[dict]:
        """A row for each object, for the table of objects."""
        for num in self.numbers():
            value = self.object(num)
            stream = isinstance(value, Stream)
            kind = "stream" if stream else {dict: "dict", list: "array", bytes: "string", Name: "name", int: "integer", float: "real", bool: "boolean"}.get(type(value), "null")
            gen, start, _ = self.places.get(num, (0, None, None))
            yield {"obj_num": num, "gen": gen, "kind": kind, "value": serialize(value.dict if stream else value).decode("latin-1"), "raw": value.raw if stream else None, "byte_offset": start, "in_objstm": num not in self.places, "refs": list(self.references(value))}


class Page:
    def __init__(self, document: "Document", number: int, spec: dict, num: int | None):
        self.document, self.number, self.spec, self.num = document, number, spec, num
        self.file = document.file

    def _box(self, key: str, default: tuple) -> tuple:
        box = self.file.resolve(self.spec.get(key))
        box = [self.file.resolve(x) for x in box] if isinstance(box, list) else []
        if len(box) < 4 or not all(map(is_number, box[:4])):
            return default
        x0, y0, x1, y1 = map(float, box[:4])
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    @cached_property
    def mediabox(self) -> tuple:
        return self._box("MediaBox", LETTER)

    @cached_property
    def cropbox(self) -> tuple:
        return self._box("CropBox", self.mediabox)

    @property
    def rotation(self) -> int:
        turn = self.file.resolve(self.spec.get("Rotate"))
        return int(turn) % 360 if is_number(turn) else 0

    @cached_property
    def rect(self) -> tuple:
        x0, y0, x1, y1 = self.cropbox
        w, h = x1 - x0, y1 - y0
        return (0.0, 0.0, h, w) if self.rotation in (90, 270) else (0.0, 0.0, w, h)

    @property
    def width(self) -> float:
        return self.rect[2]

    @property
    def height(self) -> float:
        return self.rect[3]

    @property
    def contents(self) -> bytes:
        """The decoded content streams, joined by line ends; what is no stream is left out. Malformed where one can't be decoded."""
        own = self.file.resolve(self.spec.get("Contents"))
        out = []
        for item in own if isinstance(own, list) else [own]:
            item = self.file.resolve(item)
            for part in item if isinstance(item, list) else [item]:
                part = self.file.resolve(part)
                if isinstance(part, Stream):
                    out.append(self.file.decoded(part))
        return b"\n".join(out)

    def glyphs(self) -> Iterator[tuple]:
        box = self.mediabox
        return glyphs(self.contents, self.font, box[3] - box[1])

    def font(self, name: str) -> Font | None:
        resources = self.file.resolve(self.spec.get("Resources"))
        fonts = self.file.resolve(resources.get("Font")) if isinstance(resources, dict) else None
        ref = fonts.get(name) if isinstance(fonts, dict) else None
        key = ref if isinstance(ref, Ref) else (self.number, name)
        if key not in self.document.fonts:
            spec = self.file.resolve(ref)
            self.document.fonts[key] = Font(spec, self.file.resolve, self.file.decoded) if isinstance(spec, dict) else None
        return self.document.fonts[key]

    def flipped(self, box) -> tuple:
        """A rectangle of the page with y down from its top; zeros where there are not four numbers."""
        box = self.file.resolve(box)
        box = [self.file.resolve(x) for x in box] if isinstance(box, list) else []
        if len(box) != 4 or not all(map(is_number, box)):
            return 0.0, 0.0, 0.0, 0.0
        x0, y0, x1, y1 = map(float, box)
        media = self.mediabox
        h = media[3] - media[1]
        return min(x0, x1), h - max(y0, y1), max(x0, x1), h - min(y0, y1)

    def _annotations(self) -> list[dict]:
        found = self.file.resolve(self.spec.get("Annots"))
        return [a for x in (found if isinstance(found, list) else []) if isinstance(a := self.file.resolve(x), dict)]

    def annots(self) -> list[dict]:
        out = []
        for a in self._annotations():
            kind = self.file.resolve(a.get("Subtype"))
            text = {k: text_string(self.file.resolve(a.get(v))) for k, v in (("content", "Contents"), ("title", "T"), ("name", "NM"))}
            out.append({"type": str(kind) if isinstance(kind, Name) else "Unknown", "rect": self.flipped(a.get("Rect")), **text, "content": text["content"] or ""})
        return out

    def links(self) -> list[dict]:
        out = []
        for a in self._annotations():
            if self.file.resolve(a.get("Subtype")) == "Link":
                where = self.document.destination(a["Dest"]) if "Dest" in a else self.document.action(a["A"]) if "A" in a else NOWHERE
                out.append({"from": self.flipped(a.get("Rect")), **where})
        return out

    def images(self) -> list[dict]:
        """The images of the page's resources and of forms in them, each object once."""
        out, seen, stack = [], set(), []

        def enter(resources):
            resources = self.file.resolve(resources)
            found = self.file.resolve(resources.get("XObject")) if isinstance(resources, dict) else None
            stack.extend(reversed((found if isinstance(found, dict) else {}).items()))

        enter(self.spec.get("Resources"))
        while stack:
            name, ref = stack.pop()
            xref = ref.num if isinstance(ref, Ref) else None
            if xref in seen:
                continue
            if xref is not None:
                seen.add(xref)
            value = self.file.resolve(ref)
            if isinstance(value, Stream):
                kind = self.file.resolve(value.dict.get("Subtype"))
                if kind == "Image":
                    out.append(Image(value, self.file.resolve, self.file.decoded).info() | {"xref": xref, "name": name})
                elif kind == "Form":
                    enter(value.dict.get("Resources"))
        return out


class Document:
    """Pages, outline and destinations over a PdfFile."""

    def __init__(self, data: bytes):
        self.file = PdfFile(data)
        self.fonts: dict = {}
        self.pages = [Page(self, k, spec, num) for k, (spec, num) in enumerate(self._leaves())]
        self.page_of = {}
        for p in self.pages:
            if p.num is not None:
                self.page_of.setdefault(p.num, p.number)
        self._named: dict[str, object] | None = None

    def _leaves(self) -> list[tuple[dict, int | None]]:
        """The leaves of the page tree from left to right with what they inherit; each referenced node counts once."""
        out, seen, stack = [], set(), [(self.file.catalog.get("Pages"), {})]
        while stack:
            ref, above = stack.pop()
            num = ref.num if isinstance(ref, Ref) else None
            node = self.file.resolve(ref)
            if not isinstance(node, dict) or num in seen:
                continue
            if num is not None:
                seen.add(num)
            if self.file.resolve(node.get("Type")) == "Pages":
                kids = self.file.resolve(node.get("Kids"))
                own = above | {k: node[k] for k in INHERITED if k in node}
                stack.extend((kid, own) for kid in reversed(kids if isinstance(kids, list) else []))
            else:
                out.append((above | node, num))
        return out

    @property
    def metadata(self) -> dict:
        info = self.file.info or {}
        out = {"format": f"PDF {self.file.version}"} | {k: text_string(self.file.resolve(info.get(v))) for k, v in INFO_KEYS.items()}
        return out | {"encryption": "Standard" if self.encrypted else None}

    @property
    def encrypted(self) -> bool:
        return self.file.security is not None

    def page(self, k: int) -> Page:
        if not -len(self.pages) <= k < len(self.pages):
            raise PageNotFound(f"page {k} of {len(self.pages)}")
        return self.pages[k]

    def page_index(self, target) -> int | None:
        if isinstance(target, Ref):
            found = self.page_of.get(target.num)
            return found if found is not None else self.page_index(self.file.resolve(target)) if not isinstance(self.file.resolve(target), (dict, Stream, Ref)) else None
        return target if isinstance(target, int) and not isinstance(target, bool) and 0 <= target < len(self.pages) else None

    def destination(self, dest) -> dict:
        dest = self.file.resolve(dest)
        if isinstance(dest, (Name, bytes)):
            found = self.file.resolve(self.named().get(dest if isinstance(dest, Name) else dest.decode("latin-1")))
            found = self.file.resolve(found.get("D")) if isinstance(found, dict) else found
            return self._explicit(found) if isinstance(found, list) else NOWHERE | {"kind": "goto"}
        if isinstance(dest, list):
            return self._explicit(dest)
        return self.action(dest) if isinstance(dest, dict) else dict(NOWHERE)

    def _explicit(self, dest: list) -> dict:
        """The page, and the point that the third and fourth entries give, whatever the kind of view."""
        x, y = (self.file.resolve(v) for v in (dest[2], dest[3])) if len(dest) >= 4 else (None, None)
        to = (float(x) if is_number(x) else 0.0, float(y) if is_number(y) else 0.0) if is_number(x) or is_number(y) else None
        return {"kind": "goto", "page": self.page_index(dest[0]) if dest else None, "to": to, "uri": None}

    def action(self, action) -> dict:
        action = self.file.resolve(action)
        kind = self.file.resolve(action.get("S")) if isinstance(action, dict) else None
        if kind == "GoTo":
            inner = self.file.resolve(action.get("D"))
            return dict(NOWHERE) if isinstance(inner, dict) else self.destination(inner)
        if kind == "URI":
            uri = self.file.resolve(action.get("URI"))
            return NOWHERE | {"kind": "uri", "uri": uri.decode("utf-8", "replace") if isinstance(uri, bytes) else None}
        if kind == "GoToR":
            spec = self.file.resolve(action.get("F"))
            spec = self.file.resolve(spec.get("UF", spec.get("F"))) if isinstance(spec, dict) else spec
            return NOWHERE | {"kind": "remote", "uri": spec.decode("utf-8", "replace") if isinstance(spec, bytes) else None}
        return dict(NOWHERE)

    def named(self) -> dict[str, object]:
        """Named destinations: the catalog's own dictionary comes before the name tree."""
        if self._named is None:
            found, seen = {}, set()
            names = self.file.resolve(self.file.catalog.get("Names"))
            stack = [names.get("Dests")] if isinstance(names, dict) else []
            while stack:
                ref = stack.pop()
                if isinstance(ref, Ref):
                    if ref.num in seen:
                        continue
                    seen.add(ref.num)
                node = self.file.resolve(ref)
                if not isinstance(node, dict):
                    continue
                pairs = self.file.resolve(node.get("Names"))
                for key, value in zip(pairs[::2], pairs[1::2]) if isinstance(pairs, list) else ():
                    key = self.file.resolve(key)
                    if isinstance(key, bytes):
                        found.setdefault(key.decode("latin-1"), value)
                kids = self.file.resolve(node.get("Kids"))
                stack.extend(reversed(kids if isinstance(kids, list) else []))
            own = self.file.resolve(self.file.catalog.get("Dests"))
            self._named = found | ({str(k): v for k, v in own.items()} if isinstance(own, dict) else {})
        return self._named

    def outline(self) -> list[dict]:
        """The entries of the outline, parents before children: level, title and where each leads. page1 is 1-based, -1 if unknown."""
        top = self.file.resolve(self.file.catalog.get("Outlines"))
        out, seen = [], set()
        stack = [(top.get("First"), 1)] if isinstance(top, dict) else []
        while stack:
            ref, level = stack.pop()
            node = self.file.resolve(ref)
            key = ref.num if isinstance(ref, Ref) else id(node)
            if not isinstance(node, dict) or key in seen:
                continue
            seen.add(key)
            where = self.destination(node["Dest"]) if "Dest" in node else self.action(node["A"]) if "A" in node else NOWHERE
            title = text_string(self.file.resolve(node.get("Title"))) or ""
            out.append({"level": level, "title": title, "page1": -1 if where["page"] is None else where["page"] + 1, **where})
            stack.append((node.get("Next"), level))
            if "First" in node:
                stack.append((node["First"], level + 1))
        return out

    def image(self, xref: int) -> dict:
        value = self.file.object(xref)
        if not isinstance(value, Stream):
            raise Malformed(f"object {xref} is no stream")
        return Image(value, self.file.resolve, self.file.decoded).extract()


__all__ = ["Document", "Encrypted", "Page", "PdfFile", "text_string"]
