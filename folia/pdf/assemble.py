"""Writing PDF files: new ones, general object graphs, and text stamped onto existing pages."""

from __future__ import annotations

import re

from folia.errors import FoliaError, PageNotFound
from folia.pdf.document import Document
from folia.pdf.fonts import standard_name
from folia.pdf.layout import place
from folia.pdf.syntax import Name, Ref, Stream, literal, number, serialize

#: The first bytes of a file, and the size of a page that none is given for.
HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
WIDTH, HEIGHT, SIZE = 612.0, 792.0, 11.0


def encode_text(text: str) -> bytes:
    """Text in the encoding of the fonts written here; what it lacks becomes a question mark."""
    return text.encode("cp1252", "replace")


def draw(x: float, y: float, text: str, font: str, size: float, color=None) -> bytes:
    """The operators that show a line with its baseline at (x, y), y up."""
    paint = f"{' '.join(number(float(c), 4) for c in color)} rg " if color else ""
    return f"q {paint}BT /{font} {number(size, 4)} Tf {number(x, 4)} {number(y, 4)} Td ".encode() + literal(encode_text(text)) + b" Tj ET Q\n"


class Ink:
    """The operators of one page and the fonts that they use."""

    def __init__(self, height: float, first: int = 1, taken=()):
        self.height, self.data, self.fonts, self.next, self.taken = height, b"", {}, first, set(taken)

    def font(self, name: str) -> str:
        base = standard_name(name)
        if base not in self.fonts:
            while f"F{self.next}" in self.taken:
                self.next += 1
            self.fonts[base] = f"F{self.next}"
            self.next += 1
        return self.fonts[base]

    def insert_text(self, point, text: str, fontsize: float = SIZE, fontname: str = "helv", color=None) -> None:
        self.data += draw(point[0], self.height - point[1], text, self.font(fontname), fontsize, color)

    def insert_textbox(self, rect, text: str, fontsize: float = SIZE, fontname: str = "helv", color=None, align: str = "center", valign: str = "center", line_spacing: float = 1.2) -> tuple:
        placed, used = place(rect, text, standard_name(fontname), fontsize, align, valign, line_spacing)
        for x, y, line in placed:
            self.insert_text((x, y), line, fontsize, fontname, color)
        return used


def font_object(base: str) -> dict:
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding")}


def _table(places: dict[int, int]) -> bytes:
    """Cross-reference sections for the objects at those places."""
    out, numbers = bytearray(), sorted(places)
    runs: list[list[int]] = []
    for n in numbers:
        if runs and runs[-1][-1] + 1 == n:
            runs[-1].append(n)
        else:
            runs.append([n])
    for run in runs:
        out += b"%d %d\n" % (run[0], len(run)) + b"".join(b"%010d %05d %c \n" % (places[n], 65535 if n == 0 else 0, ord("f") if n == 0 else ord("n")) for n in run)
    return bytes(out)


def build(objects: dict[int, object], trailer: dict) -> bytes:
    """A file of numbered objects."""
    out, places = bytearray(HEADER), {0: 0}
    for num in sorted(objects):
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + serialize(objects[num]) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + _table(places) + b"trailer\n" + serialize({"Size": max(places) + 1} | trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


class Writer:
    """A new document: catalog, page list, fonts in the order of their first use, then pages and contents."""

    def __init__(self):
        self.pages: list[tuple[float, float, Ink]] = []

    def add_page(self, width: float = WIDTH, height: float = HEIGHT) -> Ink:
        ink = Ink(height)
        self.pages.append((width, height, ink))
        return ink

    def to_bytes(self, info: dict | None = None) -> bytes:
        bases = list(dict.fromkeys(b for _, _, ink in self.pages for b in ink.fonts))
        font_at = {b: 3 + k for k, b in enumerate(bases)}
        first = 3 + len(bases)
        objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
        objects[2] = {"Type": Name("Pages"), "Kids": [Ref(first + 2 * k, 0) for k in range(len(self.pages))], "Count": len(self.pages)}
        objects |= {n: font_object(b) for b, n in font_at.items()}
        for k, (width, height, ink) in enumerate(self.pages):
            fonts = {name: Ref(font_at[base], 0) for base, name in ink.fonts.items()}
            objects[first + 2 * k] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, width, height], "Resources": {"Font": fonts}, "Contents": Ref(first + 2 * k + 1, 0)}
            objects[first + 2 * k + 1] = Stream({}, ink.data)
        trailer = {"Root": Ref(1, 0)}
        if info:
            objects[max(objects) + 1] = info
            trailer["Info"] = Ref(max(objects), 0)
        return build(objects, trailer)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())


class Stamps:
    """Edits of an open document; saved() appends them to its bytes, which are otherwise left as they are."""

    def __init__(self, document: Document):
        self.document, self.ink = document, {}

    def page(self, k: int) -> Ink:
        if self.document.encrypted:
            raise FoliaError("an encrypted document can't be edited")
        page = self.document.page(k)
        if page.num is None:
            raise PageNotFound(f"page {k} has no object of its own")
        if page.number not in self.ink:
            resources = self.document.file.resolve(page.spec.get("Resources"))
            fonts = self.document.file.resolve(resources.get("Font")) if isinstance(resources, dict) else None
            media = page.mediabox
            self.ink[page.number] = Ink(media[3] - media[1], taken=fonts if isinstance(fonts, dict) else ())
        return self.ink[page.number]

    def saved(self) -> bytes:
        file = self.document.file
        out, places = file.data, {}
        if not any(ink.data for ink in self.ink.values()):
            return out
        out += b"" if out.endswith(b"\n") else b"\n"
        free = file.max_number() + 1

        def put(num: int, value) -> None:
            nonlocal out
            places[num] = len(out)
            out += b"%d 0 obj\n" % num + serialize(value) + b"\nendobj\n"

        for k in sorted(self.ink):
            ink, page = self.ink[k], self.document.pages[k]
            if not ink.data:
                continue
            content, free = free, free + 1
            put(content, Stream({}, ink.data))
            fonts = {}
            for base, name in ink.fonts.items():
                fonts[name] = Ref(free, 0)
                put(free, font_object(base))
                free += 1
            spec = dict(file.object(page.num))
            old = spec.get("Contents")
            inner = file.resolve(old)
            spec["Contents"] = [*(inner if isinstance(inner, list) else [] if old is None else [old]), Ref(content, 0)]
            resources = dict(file.resolve(page.spec.get("Resources")) or {})
            resources["Font"] = dict(file.resolve(resources.get("Font")) or {}) | fonts
            put(page.num, spec | {"Resources": resources})
        start = len(out)
        last = re.findall(rb"startxref\s+(\d+)", file.data)
        trailer = {k: file.trailer[k] for k in ("Root", "Info", "ID") if k in file.trailer}
        trailer |= {"Size": free} | ({"Prev": int(last[-1])} if last else {})
        return out + b"xref\n" + _table(places) + b"trailer\n" + serialize(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start
