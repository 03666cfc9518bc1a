"""Writing PDFs from tables of drawing commands.

A command is a row (doc_id, page, seq, kind, x0, y0, x1, y1, text, fontname, fontsize, align, valign, line_spacing, color): kind
'text' puts a line at (x0, y0), 'box' wraps a text in the rectangle. Layout is Column arithmetic; a document is put together
where its commands meet, in one shuffle on doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions import text as T

COLUMNS = ["doc_id", "page", "seq", "kind", "x0", "y0", "x1", "y1", "text", "fontname", "fontsize", "align", "valign", "line_spacing", "color"]
#: What a command has where a column is missing.
DEFAULTS = {"page": ("int", 0), "seq": ("int", 0), "kind": ("string", "text"), "x0": ("double", 72.0), "y0": ("double", 72.0), "x1": ("double", None), "y1": ("double", None), "fontname": ("string", "helv"), "fontsize": ("double", 11.0), "align": ("string", "center"), "valign": ("string", "center"), "line_spacing": ("double", 1.2), "color": ("array<double>", None)}


def commands(df: DataFrame) -> DataFrame:
    """df with all columns of a command."""
    return df.select("doc_id", *[(F.col(c) if c in df.columns else F.lit(v)).cast(k).alias(c) for c, (k, v) in DEFAULTS.items()], F.coalesce("text", F.lit("")).alias("text")).select(*COLUMNS)


def laid_out(df: DataFrame) -> DataFrame:
    """A row for each drawn line: doc_id, page, seq, line, x, baseline (y down), text, font, size, color, and the bounds used by its command."""
    c = commands(df).withColumn("font", T.standard_name(F.col("fontname"))).withColumnRenamed("fontsize", "size")
    box, font, size, spacing = F.struct("x0", "y0", "x1", "y1"), F.col("font"), F.col("size"), F.col("line_spacing")
    c = c.withColumn("lines", F.when(F.col("kind") == "box", T.wrap(F.col("text"), font, size, F.col("x1") - F.col("x0"))).otherwise(F.array("text")))
    put = T.placed(F.col("lines"), font, size, box, F.col("align"), F.col("valign"), spacing)
    at = F.transform(put, lambda p: F.struct(F.when(F.col("kind") == "box", p["x"]).otherwise(F.col("x0")).alias("x"), F.when(F.col("kind") == "box", p["baseline"]).otherwise(F.col("y0")).alias("baseline"), p["text"].alias("text"), p["width"].alias("width")))
    c = c.withColumn("both", T.let(at, lambda p: F.struct(p.alias("placed"), T.used_bounds(p, size, spacing).alias("used"))))
    out = c.select("doc_id", "page", "seq", F.col("both.used").alias("used"), "color", "font", "size", F.posexplode("both.placed").alias("line", "p"))
    return out.select("doc_id", "page", "seq", "line", "p.x", "p.baseline", "p.text", "p.width", "font", "size", "color", "used")


def write_documents(df: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """doc_id, content: a PDF of each document's commands; pages are numbered from 0 and those without commands are blank."""
    drawn = laid_out(df).select("doc_id", "page", "seq", "line", "x", "baseline", "text", "font", "size", "color")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from folia.pdf.assemble import Writer

        writer, rows = Writer(), pdf.sort_values(["page", "seq", "line"], kind="stable")
        inks = [writer.add_page(width, height) for _ in range(int(rows["page"].max()) + 1)]
        for r in rows.itertuples(index=False):
            inks[int(r.page)].insert_text((r.x, r.baseline), r.text, r.size, r.font, r.color)
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "content": [writer.to_bytes()]})

    kind = dict(df.dtypes)["doc_id"]
    return drawn.groupBy("doc_id").applyInPandas(build, f"doc_id {kind}, content binary")


def stamp(files: DataFrame, df: DataFrame) -> DataFrame:
    """doc_id, content, error: files (doc_id, content) with commands drawn onto their pages; a document without commands stays byte for byte."""
    edits = commands(df).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in COLUMNS if c != "doc_id"]))).alias("edits"))
    kind = dict(files.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folia.pdf.assemble import Stamps
        from folia.pdf.document import Document

        for batch in batches:
            contents, errors = [], []
            for data, own in zip(batch.column("content").to_pylist(), batch.column("edits").to_pylist()):
                error = None
                if own:
                    try:
                        stamps = Stamps(Document(data))
                        for e in own:
                            page = stamps.page(e["page"])
                            if e["kind"] == "box":
                                page.insert_textbox((e["x0"], e["y0"], e["x1"], e["y1"]), e["text"], e["fontsize"], e["fontname"], e["color"], e["align"], e["valign"], e["line_spacing"])
                            else:
                                page.insert_text((e["x0"], e["y0"]), e["text"], e["fontsize"], e["fontname"], e["color"])
                        data = stamps.saved()
                    except Exception as x:
                        error = f"{type(x).__name__}: {x}"
                contents.append(data)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "content", "error"])

    return files.select("doc_id", "content").join(edits, "doc_id", "left").mapInArrow(run, f"doc_id {kind}, content binary, error string")


def build_documents(df: DataFrame) -> DataFrame:
    """doc_id, content from general objects: rows (doc_id, num, body) of PDF syntax, body as binary, and the trailer at num 0."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from folia.pdf.assemble import HEADER, _table

        out, places, trailer = HEADER, {0: 0}, b"<<>>"
        for r in pdf.sort_values("num", kind="stable").itertuples(index=False):
            if r.num == 0:
                trailer = bytes(r.body)
                continue
            places[int(r.num)] = len(out)
            out += b"%d 0 obj\n" % r.num + bytes(r.body) + b"\nendobj\n"
        start = len(out)
        out += b"xref\n" + _table(places) + b"trailer\n" + trailer + b"\nstartxref\n%d\n%%%%EOF\n" % start
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [out]})

    return df.groupBy("doc_id").applyInPandas(build, f"doc_id {dict(df.dtypes)['doc_id']}, content binary")


def save_files(df: DataFrame, folder: str, name_col: str = "doc_id", content_col: str = "content", suffix: str = ".pdf") -> DataFrame:
    """Writes each content to folder/name + suffix, whole or not at all; returns path and length. folder is a URI that pyarrow opens."""
    import uuid

    def run(batches):
        import pyarrow.fs as pafs

        for batch in batches:
            fs, root = (pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")) if folder.startswith("file:") else pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
            fs.create_dir(root, recursive=True)
            paths, sizes = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{name}{suffix}"
                part = f"{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(data or b"")
                fs.move(part, path)
                paths.append(path)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_pydict({"path": paths, "length": pa.array(sizes, pa.int64())})

    return df.select(F.col(name_col).cast("string"), content_col).mapInArrow(run, "path string, length bigint")
