"""Streams of arriving PDF files to tables: each file is parsed once, in the micro-batch that finds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folia.sources.tables import table

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """doc_id (the path), modificationTime, length and content of files as they arrive in a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder).withColumnRenamed("path", "doc_id")


def stream_table(files: DataFrame, name: str) -> DataFrame:
    """A table of the arriving files. Parsing keeps no state, so any output mode and sink will do."""
    return table(files, name)


def ingest(files: DataFrame, folder: str, checkpoint: str, tables=("documents", "pages", "glyphs"), once: bool = True) -> StreamingQuery:
    """Writes tables of arriving files to folder/<table>. A micro-batch that runs again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name in tables:
            table(batch, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
