"""One document at a time, without Spark: open, look, extract, stamp, save."""

from __future__ import annotations

import os
from collections.abc import Iterator

from folia import render
from folia.errors import DocumentClosed, FileNotFound, FoliaError
from folia.pdf import document as model
from folia.pdf import layout as L
from folia.pdf.assemble import Stamps, Writer
from folia.pdf.images import Pixmap


class Page:
    """A page of an open document."""

    def __init__(self, document: "Document", page: model.Page):
        self.document, self.own, self.number = document, page, page.number
        self._blocks: list | None = None

    def __getattr__(self, name: str):
        if name in ("mediabox", "cropbox", "rotation", "rect", "width", "height", "contents", "spec"):
            return getattr(self.own, name)
        raise AttributeError(name)

    @property
    def blocks(self) -> list:
        """The page's glyphs by block and line."""
        if self._blocks is None:
            self._blocks = L.blocks(L.lines([L.Glyph(*g, seq=k) for k, g in enumerate(self.own.glyphs())]))
        return self._blocks

    def get_text(self, mode: str = "text"):
        """text, words (x0, y0, x1, y1, word, block, line, word_no), blocks (x0, y0, x1, y1, text, block, 0) or dict, which rawdict equals."""
        numbered = [(b, k, line) for b, block in enumerate(self.blocks) for k, line in enumerate(block)]
        if mode == "text":
            return L.page_text(self.blocks)
        if mode == "words":
            return [(*L.bbox(w), "".join(g.text for g in w), b, k, n) for b, k, line in numbered for n, w in enumerate(L.line_words(line))]
        if mode == "blocks":
            return [(*L.bbox([g for line in block for g in line]), "\n".join(map(L.line_text, block)), b, 0) for b, block in enumerate(self.blocks)]
        if mode in ("dict", "rawdict"):
            x0, y0, x1, y1 = self.mediabox
            return {"width": x1 - x0, "height": y1 - y0, "blocks": [{"type": 0, "number": b, "bbox": L.bbox([g for line in block for g in line]), "lines": [{"bbox": L.bbox(line), "spans": [{"text": "".join(g.text for g in s), "font": "Font", "size": s[0].size, "bbox": L.bbox(s)} for s in L.line_spans(line)]} for line in block]} for b, block in enumerate(self.blocks)]}
        raise ValueError(f"unknown text mode: {mode}")

    def links(self) -> list[dict]:
        return self.own.links()

    def annots(self) -> list[dict]:
        return self.own.annots()

    def images(self) -> list[dict]:
        return self.own.images()

    def pixmap(self, matrix=None, dpi=None, colorspace="rgb", alpha=False) -> Pixmap:
        return render.render(self.document.file.data, self.number, render.zoom(matrix, dpi), None, colorspace, alpha)

    def __str__(self) -> str:
        return f"page {self.number} of {self.document.name}"


class Document:
    """An open document; also a context manager and a sequence of pages."""

    def __init__(self, path: str | None = None, stream: bytes | None = None):
        if stream is None and path is None:
            raise ValueError("a path or bytes are needed")
        if stream is None:
            if not os.path.exists(path):
                raise FileNotFound(path)
            with open(path, "rb") as f:
                stream = f.read()
        self.name = "<stream>" if path is None else str(path)
        self._model = model.Document(stream)
        self._stamps, self._pages, self.closed = Stamps(self._model), {}, False

    @property
    def model(self) -> model.Document:
        if self.closed:
            raise DocumentClosed(self.name)
        return self._model

    @property
    def file(self) -> model.PdfFile:
        return self.model.file

    @property
    def page_count(self) -> int:
        return len(self.model.pages)

    __len__ = lambda self: self.page_count

    @property
    def metadata(self) -> dict:
        return self.model.metadata

    @property
    def encrypted(self) -> bool:
        return self.model.encrypted

    def load_page(self, k: int) -> Page:
        page = self.model.page(k)
        return self._pages.setdefault(page.number, Page(self, page))

    __getitem__ = load_page

    def __iter__(self) -> Iterator[Page]:
        return (self.load_page(k) for k in range(self.page_count))

    def toc(self, simple: bool = True) -> list:
        """[level, title, page from 1] of each outline entry; otherwise also where it leads."""
        return [[t["level"], t["title"], t["page1"]] + ([] if simple else [{k: t[k] for k in ("kind", "page", "to", "uri")}]) for t in self.model.outline()]

    def image(self, xref: int) -> dict:
        return self.model.image(xref)

    def raw_bytes(self) -> bytes:
        return self.file.data

    def insert_text(self, page: int, point, text: str, **style) -> None:
        self.model  # noqa: B018  raises if closed
        self._stamps.page(page).insert_text(point, text, **style)

    def insert_textbox(self, page: int, rect, text: str, **style) -> tuple:
        self.model  # noqa: B018
        return self._stamps.page(page).insert_textbox(rect, text, **style)

    def save(self, path: str | None = None) -> bytes:
        """The document's bytes with what was inserted appended; without insertions the bytes it was opened with."""
        self.model  # noqa: B018
        data = self._stamps.saved()
        if path is not None:
            with open(path, "wb") as f:
                f.write(data)
        return data

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> "Document":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __str__(self) -> str:
        return f"Document({self.name})"


def open_pdf(path: str | None = None, stream: bytes | None = None) -> Document:
    return Document(path, stream)


def from_bytes(data: bytes) -> Document:
    return Document(stream=data)


__all__ = ["Document", "FoliaError", "Page", "Pixmap", "Writer", "from_bytes", "open_pdf"]
