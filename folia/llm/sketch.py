"""Counts of hashes over all documents, in a table of fixed size.

Tasks count on their own and yield their table in compressed pieces; pieces are added by key, first on many tasks, then on
one for each piece. The driver reads 2**BITS numbers, however large the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import tidied

#: Bits of the table's width (4 million counts) and its pieces.
BITS, PIECES = 22, 64
#: Hashes that are gathered before they are counted.
GATHERED = 1 << 20


def places(found: np.ndarray) -> np.ndarray:
    """Where hashes are counted."""
    return (found >> np.uint64(64 - BITS)).astype(np.int64)


class Counter:
    """The counts of one task."""

    def __init__(self):
        self.counts, self.waiting, self.held = np.zeros(1 << BITS, dtype=np.uint32), [], 0

    def add(self, found: np.ndarray) -> None:
        self.waiting.append(found)
        self.held += len(found)
        if self.held > GATHERED:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.counts += np.bincount(places(np.concatenate(self.waiting)), minlength=len(self.counts)).astype(np.uint32)
        self.waiting, self.held = [], 0

    def pieces(self) -> list[tuple[int, bytes]]:
        self.settle()
        return [(k, packed(x)) for k, x in enumerate(self.counts.reshape(PIECES, -1)) if x.any()]


def packed(x: np.ndarray) -> bytes:
    """Counts by planes of bytes, of which all but the lowest are nearly empty."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each piece's counts in a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
            sums[piece] = sums[piece] + unpacked(data) if piece in sums else unpacked(data)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())], names=["piece", "counts"])


def total(rows: DataFrame) -> np.ndarray:
    """The counts of all tasks from rows (piece int, counts binary)."""
    for key in (["piece", F.spark_partition_id() % 16], ["piece"]):
        rows = rows.repartition(*[F.col(k) if isinstance(k, str) else k for k in key]).mapInArrow(tidied(_added), "piece int, counts binary")
    out = np.zeros((PIECES, (1 << BITS) // PIECES), dtype=np.uint32)
    for r in rows.toLocalIterator():
        out[r.piece] += unpacked(bytes(r.counts))
    return out.ravel()
