"""spark.read.format("pdf"): tables of PDF files as a Python data source, and table functions for SQL.

register(spark), then spark.read.format("pdf").option("table", "glyphs").load("/folder/*.pdf"). Files are dealt
out by size; each task reads and parses its files. Filters on doc_id are applied to the paths before anything is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folia.sources.tables import SCHEMAS, batches, parse

#: Bytes of files that one task takes at least.
TASK_BYTES = 32 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.table, self.only = options.get("table", "documents"), None
        self.path, self.arrow = options["path"], to_arrow_schema(schema)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("doc_id",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[Files]:
        import fnmatch
        import os

        import pyarrow.fs as pafs

        fs, path = (pafs.FileSystem.from_uri(self.path)) if "://" in self.path else (pafs.LocalFileSystem(), os.path.abspath(self.path.removeprefix("file:")))
        pattern = any(c in path for c in "*?[")
        root = path[: min(path.index(c) for c in "*?[" if c in path)].rpartition("/")[0] if pattern else path
        if self.only is not None:  # a pinned file is looked up by its path, without listing the folder
            infos = [fs.get_file_info(self.only)] if self.only.startswith(root) else []
        else:
            infos = [fs.get_file_info(path)] if not pattern and fs.get_file_info(path).type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        groups, held = [[]], 0
        for info in sorted(infos, key=lambda i: i.path):
            if info.type == pafs.FileType.File and (not pattern or fnmatch.fnmatch(info.path, path)) and self.only in (None, info.path):
                if held >= TASK_BYTES:
                    groups.append([])
                    held = 0
                groups[-1].append(info.path)
                held += info.size or 0
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()

        def contents():
            for path in partition.paths:
                with fs.open_input_stream(path) as f:
                    yield path, f.read()

        yield from batches(self.table, self.arrow, contents())


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "documents")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdfReader(schema, dict(self.options))


def _function(name: str):
    fields = [f.name for f in StructType.fromDDL(SCHEMAS[name])]

    class Parse:
        def eval(self, doc_id: str, content: bytes):
            for row in parse(name, doc_id, bytes(content) if content is not None else None):
                yield row if isinstance(row, tuple) else tuple(row.get(f) for f in fields)

    return udtf(Parse, returnType=SCHEMAS[name])


def register(spark: SparkSession) -> None:
    """The format pdf, and pdf_<table>(doc_id, content) for use with LATERAL in SQL."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
    for name in SCHEMAS:
        spark.udtf.register(f"pdf_{name}", _function(name))
