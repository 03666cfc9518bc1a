"""What the operators share: shared storage, word expressions, checked broadcasts, connected components."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.storage import shared_dir, shared_path, written

__all__ = ["shared_dir", "shared_path", "written"]

#: The characters that part words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows up to which a small side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (with weight: of at most ten times that weight in all); otherwise df as it is. df should be cheap to count."""
    head = df.limit(rows + 1)
    n, heavy = head.agg(F.count("*"), F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and heavy <= 10 * rows else df


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def light_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold at most so many rows, so that long texts don't add up in a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def tidied(run):
    """run (batches to batches) that gives freed memory back to the system at the end of a task: workers live on, and what they keep adds up."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def let(value: Column, body) -> Column:
    """body(value) with value computed once, for use inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def n_words(text: Column) -> Column:
    """The number of words of a text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """The connected components of undirected edges (a long, b long): rows (node, component), component the smallest node.

    Large-star and small-star steps alternate, each a shuffle on one end of the edges; the driver sees counts alone.
    Every round is written to the shared folder; rounds go on until every edge leads to the smallest node, or nothing changes.
    Loops and repeated edges are harmless; null ends are left out.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs = written(pairs, label)
    state = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(near, "u")
        pairs = written(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), label)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if now == state or now[0] == 0 or (now[0] == now[2] and pairs.join(pairs.select(F.col("u").alias("w")), pairs.v == F.col("w"), "left_semi").limit(1).count() == 0):
            break
        state = now
    top = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top).groupBy("node").agg(F.min("component").alias("component"))
