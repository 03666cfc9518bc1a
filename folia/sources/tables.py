"""Tables of a corpus of PDF files, each from one parse of each document.

Input is any DataFrame with a string id and a binary column. Each table has a profile of its own, so that a query for
links doesn't interpret glyphs. Parsing runs in Arrow batches within the scan's tasks, without a shuffle; a document that
can't be read never fails the job: it has a row in documents with error_class and error_message and none elsewhere. Where only
a part can't be read, that part alone is missing from a table: the table errors names it, and contents has the page's error.

Use table(), or Corpus for several tables of one input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"
META = ("format", "title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate", "encryption")

#: Rows of an output batch.
BATCH = 4096

SCHEMAS = {
    "documents": f"doc_id string, version string, page_count int, encrypted boolean, metadata struct<{','.join(f'{k}:string' for k in META)}>, error_class string, error_message string",
    "objects": "doc_id string, obj_num bigint, gen bigint, kind string, value string, raw binary, byte_offset bigint, in_objstm boolean, refs array<bigint>",
    "pages": f"doc_id string, page int, obj_num bigint, mediabox {RECT}, cropbox {RECT}, rotation int, rect {RECT}, width double, height double",
    "contents": "doc_id string, page int, contents binary, error_class string, error_message string",
    "glyphs": "doc_id string, page int, seq int, code int, text string, x0 double, y0 double, x1 double, y1 double, ox double, oy double, font string, size double",
    "toc": f"doc_id string, seq int, level int, title string, page int, kind string, dest_page int, to {POINT}, uri string",
    "links": f"doc_id string, page int, seq int, from {RECT}, kind string, dest_page int, to {POINT}, uri string",
    "annots": f"doc_id string, page int, seq int, type string, rect {RECT}, content string, title string, name string",
    "images": "doc_id string, page int, seq int, xref bigint, name string, width int, height int, bpc int, colorspace string, filter string",
    "image_data": "doc_id string, xref bigint, ext string, image binary, width int, height int, colorspace string, bpc int",
    "destinations": "doc_id string, name string, dest_page int, to " + POINT,
    "errors": "doc_id string, page int, part string, error_class string, error_message string",
}


def _rect(r: tuple) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), r))


def _to(p: tuple | None) -> dict | None:
    return None if p is None else {"x": p[0], "y": p[1]}


def _documents(d) -> Iterator[dict]:
    yield {"version": d.file.version, "page_count": len(d.pages), "encrypted": d.encrypted, "metadata": d.metadata}


def _pages(d, index: int | None = None) -> Iterator[dict]:
    for p in d.pages if index is None else d.pages[index:][:1] if -len(d.pages) <= index else ():
        yield {"page": p.number, "obj_num": p.num, "mediabox": _rect(p.mediabox), "cropbox": _rect(p.cropbox), "rotation": p.rotation, "rect": _rect(p.rect), "width": p.width, "height": p.height}


def _error(e: Exception) -> dict:
    return {"error_class": type(e).__name__, "error_message": str(e)[:500]}


def _contents(d) -> Iterator[dict]:
    for p in d.pages:
        try:
            yield {"page": p.number, "contents": p.contents}
        except Exception as e:
            yield {"page": p.number} | _error(e)


def _whole(items) -> list:
    """All items of a part of a document, or none where it can't be read: the table errors says so."""
    try:
        return list(items())
    except Exception:
        return []


def _glyphs(d) -> Iterator[tuple]:
    for p in d.pages:
        for seq, (code, text, x0, y0, x1, y1, ox, oy, size) in enumerate(_whole(p.glyphs)):
            yield p.number, seq, code, text, x0, y0, x1, y1, ox, oy, "Font", size


#: What can't be read on its own, by the name of its table: parts of pages, and parts of documents.
PAGE_PARTS = {"contents": lambda p: p.contents, "glyphs": lambda p: list(p.glyphs()), "links": lambda p: p.links(), "annots": lambda p: p.annots(), "images": lambda p: p.images()}
PARTS = {"toc": lambda d: d.outline(), "destinations": lambda d: list(_destinations(d)), "objects": lambda d: list(d.file.rows())}


def _errors(d) -> Iterator[dict]:
    """The parts of a document that can't be read. Glyphs that fail for their contents are one error."""
    for p in d.pages:
        failed = False
        for part, read in PAGE_PARTS.items():
            try:
                if not (part == "glyphs" and failed):
                    read(p)
            except Exception as e:
                failed = True
                yield {"page": p.number, "part": part} | _error(e)
    for part, read in PARTS.items():
        try:
            read(d)
        except Exception as e:
            yield {"part": part} | _error(e)
    for xref in _xrefs(d):
        try:
            d.image(xref)
        except Exception as e:
            yield {"part": f"image {xref}"} | _error(e)


def _toc(d) -> Iterator[dict]:
    for seq, t in enumerate(_whole(d.outline)):
        yield {"seq": seq, "level": t["level"], "title": t["title"], "page": t["page1"], "kind": t["kind"], "dest_page": t["page"], "to": _to(t["to"]), "uri": t["uri"]}


def _links(d) -> Iterator[dict]:
    for p in d.pages:
        for seq, x in enumerate(_whole(p.links)):
            yield {"page": p.number, "seq": seq, "from": _rect(x["from"]), "kind": x["kind"], "dest_page": x["page"], "to": _to(x["to"]), "uri": x["uri"]}


def _annots(d) -> Iterator[dict]:
    for p in d.pages:
        for seq, x in enumerate(_whole(p.annots)):
            yield x | {"page": p.number, "seq": seq, "rect": _rect(x["rect"])}


def _images(d) -> Iterator[dict]:
    for p in d.pages:
        for seq, x in enumerate(_whole(p.images)):
            yield x | {"page": p.number, "seq": seq}


def _xrefs(d) -> list[int]:
    return list(dict.fromkeys(x["xref"] for p in d.pages for x in _whole(p.images) if x["xref"] is not None))


def _image_data(d) -> Iterator[dict]:
    for xref in _xrefs(d):
        for image in _whole(lambda: [d.image(xref)]):  # noqa: B023
            yield image | {"xref": xref}


def _destinations(d) -> Iterator[dict]:
    for name, dest in d.named().items():
        dest = d.file.resolve(dest)
        dest = d.file.resolve(dest.get("D")) if isinstance(dest, dict) else dest
        found = d.destination(dest) if isinstance(dest, list) else {"page": None, "to": None}
        yield {"name": name, "dest_page": found["page"], "to": _to(found["to"])}


PROFILES: dict[str, Callable] = {
    "documents": _documents,
    "objects": lambda d: d.file.rows(),
    "pages": _pages,
    "contents": _contents,
    "glyphs": _glyphs,
    "toc": _toc,
    "links": _links,
    "annots": _annots,
    "images": _images,
    "image_data": _image_data,
    "destinations": _destinations,
    "errors": _errors,
}


def parse(name: str, doc_id: str | None, content: bytes | None, profile: Callable | None = None) -> Iterator[dict]:
    """The rows of one document in a table (or those of its profile here), as dicts, or as tuples of all columns; a document that can't be opened is a row of documents alone."""
    from folia.pdf.document import Document

    try:
        rows = (profile or PROFILES[name])(Document(content or b""))
        for row in rows:
            yield (doc_id, *row) if isinstance(row, tuple) else row | {"doc_id": doc_id}
    except Exception as e:  # a scan of many documents goes on whatever one of them holds
        if name == "documents":
            yield {"doc_id": doc_id} | _error(e)


def batches(name: str, schema: pa.Schema, source: Iterator[tuple], profile: Callable | None = None) -> Iterator[pa.RecordBatch]:
    rows: list = []

    def batch() -> pa.RecordBatch:
        if isinstance(rows[0], tuple):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for doc_id, content in source:
        for row in parse(name, doc_id, content, profile):
            rows.append(row)
            if len(rows) >= BATCH:
                yield batch()
                rows = []
    if rows:
        yield batch()


def bounded(spark: SparkSession, size: int = 64 << 20) -> None:
    """Arrow batches hold at most about so many bytes, since whole files are in them; a bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > size:
        spark.conf.set(key, str(size))


def table(files: DataFrame, name: str, id_col: str = "doc_id", content_col: str = "content", profile: Callable | None = None) -> DataFrame:
    """One table of SCHEMAS over files, of the rows that profile has in place of its own."""
    schema = SCHEMAS[name]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(source):
        yield from batches(name, arrow, ((i, c) for b in source for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), profile)

    bounded(files.sparkSession)
    return files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).alias("content")).mapInArrow(run, schema)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), modificationTime, length and content of the files under a path or pattern."""
    return spark.read.format("binaryFile").load(path).withColumnRenamed("path", "doc_id")


def read_pdf(source, spark: SparkSession | None = None, **columns) -> "Corpus":
    """A corpus of a path or pattern, or of a DataFrame with ids and contents."""
    return Corpus(source if isinstance(source, DataFrame) else pdf_files(spark, source), **columns)


def header_version(content) -> object:
    """The version in a file's header as a Column, empty where there is none."""
    return F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-([0-9]+\\.[0-9]+)", 1)


def object_index(files: DataFrame) -> DataFrame:
    """doc_id, obj_num, definitions: how often each number is defined, found by pattern alone."""
    found = F.explode(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit("(?<![0-9])([0-9]{1,10})\\s+[0-9]{1,5}\\s+obj"), F.lit(1)))
    return files.select("doc_id", found.alias("n")).select("doc_id", F.col("n").cast("long").alias("obj_num")).groupBy("doc_id", "obj_num").agg(F.count("*").alias("definitions"))


class Corpus:
    """Tables over one input, each as an attribute: corpus.pages, corpus.glyphs, ..., also words, lines, blocks, spans, text and page_dict."""

    def __init__(self, files: DataFrame, id_col: str = "doc_id", content_col: str = "content"):
        self.files, self.id_col, self.content_col = files, id_col, content_col

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return table(self.files, name, self.id_col, self.content_col)
        from folia.operators import grouping

        if name in grouping.TABLES:
            return grouping.TABLES[name](self.glyphs, self)
        raise AttributeError(name)

    def page(self, index: int) -> DataFrame:
        """Rows of pages by index; negative ones count from the end of each document. Each is taken in the one parse of its document."""
        return table(self.files, "pages", self.id_col, self.content_col, lambda d: _pages(d, index))

    def create_views(self, prefix: str = "pdf_") -> None:
        """Temporary views of all tables, for SQL."""
        from folia.operators import grouping

        for name in [*SCHEMAS, *grouping.TABLES]:
            getattr(self, name).createOrReplaceTempView(prefix + name)
