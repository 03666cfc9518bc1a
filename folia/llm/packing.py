"""Token ids in files of fixed-width packed bits.

A file holds ids in the fewest bits that the vocabulary needs, little-endian, in blocks of the same number of ids; the
last block is filled up with zero bits. A footer holds the byte offset of each block, the documents' ids and where each
document starts, so any range of ids costs one read of its blocks and one vectorised unpacking. Layout:

    magic, blocks, footer, footer's length (8 bytes), magic
    footer: version, bits, ids per block, documents, ids, blocks (8 bytes each), doc_id (8 bytes each), whether doc_id is
    null (1 byte each), start of each document and the end (8 bytes each), offset of each block and the end (8 bytes each)

A dataset is a folder of such files, numbered in doc_id order. Files appear under their final name only when whole, and
a task that runs again writes the same bytes.
"""

from __future__ import annotations

import contextlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.llm.common import shared_path, small, tidied
from folia.llm.pretokens import Memo, pieces, plain

MAGIC, VERSION = b"FOLIAIDS", 1
#: Ids in a block: a multiple of 8, so that blocks end on whole bytes at any width.
BLOCK = 8192
#: Pieces whose ids a worker keeps (two generations of so many, about 200 bytes each).
KEPT = 400_000
#: Ids that are read and unpacked at once.
WINDOW = 1 << 20


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, all below 2**bits, as packed bits; the last byte is filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first count ids of packed bits, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(8, dtype=np.uint8)])
    at = np.arange(count, dtype=np.int64) * bits
    first, found = at >> 3, np.zeros(count, dtype=np.uint64)
    for k in range((bits + 7 + 7) // 8):
        found |= raw[first + k].astype(np.uint64) << np.uint64(8 * k)
    return ((found >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder that Spark names."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), uri


class Writer:
    """Writes one file, block by block; documents may be longer than memory allows for a block of documents."""

    def __init__(self, fs: pafs.FileSystem, path: str, bits: int, block: int = BLOCK):
        self.fs, self.path, self.bits, self.block = fs, path, bits, block
        self.unfinished = f"{path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.unfinished)
        self.out.write(MAGIC)
        self.offsets, self.starts, self.doc_ids, self.nulls = [len(MAGIC)], [0], [], []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} doesn't fit in {self.bits} bits")
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= WINDOW:
            self._blocks()

    def _blocks(self, last: bool = False) -> None:
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *self.waiting])
        whole = len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            self._put(ids[at : at + self.block])
        if last and whole < len(ids):
            self._put(np.pad(ids[whole:], (0, self.block - len(ids) + whole)))
            whole = len(ids)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        self._blocks(last=True)
        head = [VERSION, self.bits, self.block, len(self.doc_ids), self.starts[-1], len(self.offsets) - 1]
        footer = b"".join([np.array(head, "<u8").tobytes(), np.array(self.doc_ids, "<i8").tobytes(), np.array(self.nulls, "u1").tobytes(), np.array(self.starts, "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes()])
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:  # from a task that ran before: the same bytes
            self.fs.delete_file(self.path)
        self.fs.move(self.unfinished, self.path)

    def abandon(self) -> None:
        """Takes the unfinished file away, where the task can't go on."""
        with contextlib.suppress(OSError):
            self.out.close()
            self.fs.delete_file(self.unfinished)


class Reader:
    """Random access to one file: doc_ids, starts, and the ids of any range or document."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a file of packed ids: {path}")
        n = int.from_bytes(tail[:8], "little")
        self.file.seek(size - 16 - n)
        footer = self.file.read(n)
        version, self.bits, self.block, self.n_docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(footer, "<u8", 6))
        if version != VERSION:
            raise ValueError(f"unknown version {version}: {path}")
        at = 48
        doc_ids = np.frombuffer(footer, "<i8", self.n_docs, at)
        nulls = np.frombuffer(footer, "u1", self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if null else int(x) for x, null in zip(doc_ids, nulls)]
        self.starts = np.frombuffer(footer, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(footer, "<u8", blocks + 1, at + 17 * self.n_docs + 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        low, high = start // self.block, -(-stop // self.block)
        self.file.seek(int(self.offsets[low]))
        data = self.file.read(int(self.offsets[high] - self.offsets[low]))
        return unpack(data, (high - low) * self.block, self.bits)[start - low * self.block : stop - low * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number and ids of each document in order; short ones share a read."""
        k = 0
        while k < self.n_docs:
            start = int(self.starts[k])
            stop = max(k + 1, int(np.searchsorted(self.starts, start + WINDOW, side="right")) - 1)
            ids = self.ids(start, int(self.starts[stop]))
            for j in range(k, stop):
                yield j, ids[int(self.starts[j]) - start : int(self.starts[j + 1]) - start]
            k = stop

    def close(self) -> None:
        self.file.close()


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def library_encoder(path: str) -> tuple[Callable[[str], np.ndarray], int]:
    """How the tokenizers library encodes a text with the file at path, without special tokens, and the number that its ids stay below.

    A byte-level file without normaliser encodes each piece of a text alone, so its model is asked once for a piece and
    the answer is kept. Texts that contain an added token or characters beyond the plain ones, and other kinds of files, go
    to the library whole.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
    added = [x["content"] for x in spec.get("added_tokens") or []]
    letters, tokenize = _byte_letters(), library.model.tokenize
    memo = Memo(lambda piece: np.array([t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))], "<u4").tobytes(), KEPT)

    def encode(text: str) -> np.ndarray:
        if by_piece and plain(text) and not any(x in text for x in added):
            return np.frombuffer(b"".join(map(memo.__getitem__, pieces(text))), "<u4")
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode, max(library.get_vocab(with_added_tokens=True).values()) + 1


_ENCODERS: dict = {}


def _encoder(make, path):
    """One encoder for each worker process."""
    if (make, path) not in _ENCODERS:
        _ENCODERS[make, path] = make(path)
    return _ENCODERS[make, path]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, make=library_encoder, block: int = BLOCK) -> DataFrame:
    """Writes the ids of every text of docs (doc_id, text), each document followed by end_id, in ascending doc_id order.

    Returns the dataset's index (shard, n_docs, n_ids), kept in folder/index. Null texts count as empty; null ids come
    first; rows that share an id are ordered by text; an empty table makes an empty dataset. Other columns are not read.
    Rows are range-partitioned by id, the start of the text and a number of their own, so no key is hot, and each task streams
    its documents to one file.
    """
    spark = docs.sparkSession

    def shard(batches):
        encode, vocabulary = _encoder(make, tokenizer)
        number, out = TaskContext.get().partitionId(), None
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    if out is None:
                        fs, path = place(folder)
                        fs.create_dir(f"{path}/shards", recursive=True)
                        out = Writer(fs, f"{path}/shards/{number:07d}.ids", width(vocabulary), block)
                    ids = encode(text.as_py() or "")
                    out.add(doc_id, ids if end_id is None else np.append(ids, np.uint32(end_id)))
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.abandon()
            raise
        if out is not None:
            yield pa.RecordBatch.from_pydict({"shard": [number], "n_docs": [len(out.doc_ids)], "n_ids": [out.starts[-1]]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    ordered.mapInArrow(tidied(shard), "shard int, n_docs long, n_ids long").write.parquet(f"{folder}/index")
    return spark.read.schema("shard int, n_docs long, n_ids long").parquet(f"{folder}/index")


def _read(spark: SparkSession, folder: str, schema: str, make) -> DataFrame:
    """make(doc_id, place in its file, ids) for every document of the dataset, with the number of ids in the files before."""
    index = spark.read.schema("shard int, n_docs long, n_ids long").parquet(f"{folder}/index")
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches):
        fs, path = place(folder)
        for batch in batches:
            for number in batch.column("shard").to_pylist():
                file = Reader(fs, f"{path}/shards/{number:07d}.ids")
                made = []
                for k, ids in file.documents():
                    made.append((number, int(file.starts[k]), file.doc_ids[k], *make(ids)))
                    if len(made) >= 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in made], schema=arrow)
                        made = []
                file.close()
                if made:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in made], schema=arrow)

    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "))])
    n = max(1, index.count())
    files = index.select("shard").repartition(n)
    base = index.select(F.col("shard").alias("_s"), (F.sum("n_ids").over(W.orderBy("shard")) - F.col("n_ids")).alias("_base"))
    found = files.mapInArrow(tidied(rows), schema).join(small(base), F.col("shard") == F.col("_s")).withColumn("start", F.col("_base") + F.col("within"))
    return found.drop("_s", "_base", "within")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids of every document of a dataset."""
    return _read(spark, folder, "shard int, within long, doc_id long, ids array<long>", lambda ids: (ids.tolist(),)).select("doc_id", "start", "ids")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a dataset, from its files."""
    found = _read(spark, folder, "shard int, within long, doc_id long, n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def packed_checksums(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as a dataset in the shared folder and reads it back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "packed-ids")
    write_ids(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(spark, folder)
