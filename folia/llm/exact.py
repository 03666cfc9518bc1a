"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a number in base B modulo a prime, for two primes near 2**31, beside
its length. Fingerprints compose: of a + b it is f(a) * B**len(b) + f(b), so chunks of a huge document are hashed in
parallel, on any executor, and combined by length-shifted arithmetic.

Equal fingerprints are only candidates: their texts are then compared chunk by chunk, as the least and the greatest
chunk of each (fingerprint, chunk number). Both are partial aggregates, so a group of any size leaves one row per chunk
and task, and no group is ever gathered. A group whose chunks differ is split by text.

Scale: one pass writes about 100 bytes a document; texts move again only where fingerprints repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import small, tidied, written

#: Fixed values of the fingerprint: two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003957, 777767789)
#: Bytes hashed by one row of the matrix product; products stay below 2**53, where doubles are exact.
CHUNK = 4096
#: Bytes beyond which a document is hashed in parallel pieces, the size of a piece, and of a compared chunk.
HUGE, PIECE, COMPARED = 64 << 20, 8 << 20, 64 << 10

_POWERS = np.array([[pow(b, CHUNK - 1 - i, p) for b, p in zip(BASES, PRIMES)] for i in range(CHUNK)], dtype=np.float64)
_STEP = [pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES)]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """(length, f1, f2) of two byte strings in a row."""
    return (left[0] + right[0], *((x * pow(b, right[0], p) + y) % p for x, y, b, p in zip(left[1:], right[1:], BASES, PRIMES)))


def fingerprints(texts: list[bytes], at_once: int = 512) -> list[tuple[int, int, int]]:
    """(length, f1, f2) of each byte string; the empty one has zeros."""
    out: list[tuple[int, int, int]] = []
    start = 0
    while start < len(texts):
        stop, rows = start, 0
        while stop < len(texts) and (stop == start or rows + -(-len(texts[stop]) // CHUNK) <= at_once):
            rows += -(-len(texts[stop]) // CHUNK)
            stop += 1
        rows = max(rows, 1)
        flat, at = np.zeros(rows * CHUNK, dtype=np.float64), 0
        for t in texts[start:stop]:  # zeros in front don't change a number
            at += -(-len(t) // CHUNK) * CHUNK
            if t:
                flat[at - len(t) : at] = np.frombuffer(t, dtype=np.uint8)
        sums = (flat.reshape(rows, CHUNK) @ _POWERS).astype(np.int64)
        hashed, row = [(sums[:, k] % p).tolist() for k, p in enumerate(PRIMES)], 0
        for t in texts[start:stop]:
            n, found = -(-len(t) // CHUNK), []
            for h, step, p in zip(hashed, _STEP, PRIMES):
                f = 0
                for x in h[row : row + n]:
                    f = (f * step + x) % p
                found.append(f)
            out.append((len(t), *found))
            row += n
        start = stop
    return out


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_bytes, f1, f2 and the shifts B**length in place of the column bytes."""
    for batch in batches:
        kept = [i for i, n in enumerate(batch.schema.names) if n != "bytes"]
        found = fingerprints([x or b"" for x in batch.column("bytes").to_pylist()])
        more = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)] + [pa.array([pow(b, f[0], p) for f in found], pa.int64()) for b, p in zip(BASES, PRIMES)]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + more, names=[batch.schema.names[i] for i in kept] + ["n_bytes", "f1", "f2", "s1", "s2"])


def _pieces(df: DataFrame, size: int) -> DataFrame:
    """df with its column bytes cut into pieces of that size, numbered by no; an empty one has one piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length("bytes") / size)).cast("int")
    cut = F.explode(F.sequence(F.lit(0), n - 1))
    return df.withColumn("no", cut).withColumn("bytes", F.substring(F.col("bytes"), F.col("no") * size + 1, F.lit(size)))


def fingerprinted(docs: DataFrame, huge: int = HUGE, piece: int = PIECE) -> DataFrame:
    """doc_id, text_sha256, n_bytes, f1, f2, row (a number of the row) for every row of docs (doc_id, text)."""
    base = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    base = base.withColumn("text_sha256", F.sha2("bytes", 256))
    fields, made = "doc_id long, text_sha256 string", "n_bytes long, f1 long, f2 long, s1 long, s2 long"
    usual = base.where(F.length("bytes") <= huge).select("doc_id", "text_sha256", "bytes").mapInArrow(tidied(_hash), f"{fields}, {made}")
    large = base.where(F.length("bytes") > huge).withColumn("uid", F.monotonically_increasing_id())
    parts = _pieces(large.select("uid", "doc_id", "text_sha256", "bytes"), piece).repartition("uid", "no").mapInArrow(tidied(_hash), f"uid long, {fields}, no int, {made}")

    def step(k):
        return (lambda acc, x: (acc * x[f"s{k}"] + x[f"f{k}"]) % F.lit(PRIMES[k - 1])), F.lit(0).cast("long")

    rows = parts.groupBy("uid", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("no", "n_bytes", "f1", "f2", "s1", "s2"))).alias("each"), F.sum("n_bytes").alias("n_bytes"))
    (one, zero), (two, _) = step(1), step(2)
    rows = rows.select("doc_id", "text_sha256", "n_bytes", F.aggregate("each", zero, one).alias("f1"), F.aggregate("each", zero, two).alias("f2"))
    return usual.drop("s1", "s2").union(rows).withColumn("row", F.monotonically_increasing_id())


KEY = ["n_bytes", "f1", "f2"]


def differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The keys of members (doc_id, n_bytes, f1, f2) under which texts of docs differ in some chunk."""
    m = members.select(F.col("doc_id").alias("_id"), *KEY).distinct()
    texts = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    joined = texts.join(small(m), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.length("bytes") == F.col("n_bytes"))).select(*KEY, "bytes")
    chunks = _pieces(joined, COMPARED).groupBy(*KEY, "no").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    return chunks.where("least <> most").select(*KEY).distinct()


def deduplicated(docs: DataFrame, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text), dropped rows too.

    Null texts count as empty, and empty texts are equal. Of equal texts the row with the largest doc_id stays (the
    smallest for keep="min"); null ids rank lowest, and of rows that share that doc_id exactly one stays. Text is
    compared as it is, whatever its length. Other columns of docs are not looked at.
    """
    prints = written(fingerprinted(docs), "exact-prints")
    repeated = prints.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = written(repeated, "exact-repeated")
    if repeated.limit(1).count() == 0:
        return prints.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    members = written(prints.join(small(repeated), KEY), "exact-members")
    wrong = written(differing(docs, members), "exact-differing")
    split = members.withColumn("part", F.lit(""))
    if wrong.limit(1).count():
        flags = wrong.withColumn("bad", F.lit(True))
        split = members.join(small(flags), KEY, "left").withColumn("part", F.when(F.col("bad"), F.col("text_sha256")).otherwise(F.lit(""))).drop("bad")
    best = F.max if keep == "max" else F.min
    groups = split.groupBy(*KEY, "part").agg(F.count("*").alias("group_size"), best(F.struct("doc_id", "row")).alias("best"))
    groups = written(groups, "exact-groups")
    inside = split.join(small(groups), [*KEY, "part"])
    once = prints.join(small(repeated), KEY, "left_anti")
    return (
        inside.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256")
        .union(once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long"), F.lit(True), "text_sha256"))
    )
