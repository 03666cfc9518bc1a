"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a byte string, exactly one token can be the last one of its encoding. A token that ends at byte i and
starts at byte j is that token if it follows the last token of prefix j without a merge across their border. The table
of last tokens is filled from left to right; each entry looks back over one token's length at most. So the work is
linear in the string, appends only extend the table, and after an edit the table is filled anew from the edit until it
agrees with the old one over a whole token's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folia.llm.common import tidied
from folia.llm.pretokens import Memo, pieces


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Pieces whose ids a worker keeps (two generations of so many, about 200 bytes each), as numbers and as digits.
KEPT_PACKED, KEPT_LISTED = 100_000, 500_000
#: More than any rank.
WIDE = 1 << 32


class Vocabulary:
    """Tokens by rank, the pair each was merged from, and whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 400_000):
        self.ranks, self.most_pairs = ranks, most_pairs
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}  # by a * WIDE + b
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if a < rank and b < rank and self._reachable(a) and self._reachable(b) and self._apart(a, b):
                    self.merged[a, b], self.parts[rank] = rank, (a, b)
                    break
        #: Tokens that merges can make, by their bytes; others only encode a piece that equals them.
        self.usable = {token: rank for token, rank in ranks.items() if self._reachable(rank)}
        self.longest = max(map(len, self.usable), default=1)
        #: Every ending of these tokens, with the rank of the token that it is, or -1.
        self.endings = {token[k:]: -1 for token in self.usable for k in range(1, len(token))} | self.usable

    def _reachable(self, rank: int) -> bool:
        return len(self.tokens[rank]) == 1 or rank in self.parts

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as they are when they stand side by side.

        The merges inside a and b are undone from the latest on. While a border token of either side exists, a merge of
        the two border tokens happens if its rank comes before the merges that used them up.
        """
        before_a = before_b = None  # rank of the merge that used up the border token
        while True:
            across = self.merged.get((a, b))
            if across is not None and (before_a is None or across < before_a) and (before_b is None or across <= before_b):
                return False
            undo_a, undo_b = a in self.parts, b in self.parts
            if undo_a and (not undo_b or a > b):
                before_a, a = a, self.parts[a][1]
            elif undo_b:
                before_b, b = b, self.parts[b][0]
            else:
                return True

    def side_by_side(self, a: int, b: int) -> bool:
        key = a * WIDE + b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.most_pairs:
                self.known.clear()
            found = self.known[key] = self._apart(a, b)
        return found


class Prefixes:
    """The table of last tokens of a growing byte string that BPE encodes as one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, data: bytes, last: list[int], stop: int) -> None:
        """Adds the entries up to stop. Endings are followed back while a token may still begin there; the longest token that fits is the one."""
        v = self.vocabulary
        ending, known, check = v.endings.get, v.known.get, v.side_by_side
        for i in range(len(last), stop + 1):
            found, j = [], i - 1
            while j >= 0 and (token := ending(data[j:i])) is not None:
                if token >= 0:
                    found.append((j, token))
                j -= 1
            for j, token in reversed(found):
                if j == 0:
                    break
                before = last[j]
                fits = known(before * WIDE + token)
                if fits or (fits is None and check(before, token)):
                    break
            else:
                raise ValueError(f"byte {data[i - 1]} is not in the vocabulary")
            last.append(token)

    def append(self, more: bytes) -> None:
        """Extends the string; the entries before stay as they are."""
        self.data += more
        self._fill(self.data, self.last, len(self.data))

    def edit(self, start: int, stop: int, put: bytes) -> int:
        """Replaces bytes start to stop; returns how many entries were filled anew."""
        old, shift = self.last, len(put) - (stop - start)
        data = self.data[:start] + put + self.data[stop:]
        last, same, filled = old[: start + 1], 0, 0
        for i in range(start + 1, len(data) + 1):
            if same > self.vocabulary.longest:
                last.extend(old[i - shift :])
                break
            self._fill(data, last, i)
            filled += 1
            same = same + 1 if i >= start + len(put) and i - shift <= len(self.data) and old[i - shift] == last[i] else 0
        self.data, self.last = data, last
        return filled

    def ids(self, stop: int | None = None) -> list[int]:
        """The encoding of the string, or of its first stop bytes."""
        i, out, tokens = len(self.data) if stop is None else stop, [], self.vocabulary.tokens
        while i > 0:
            out.append(self.last[i])
            i -= len(tokens[self.last[i]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """A piece that is a token has that token alone, as rank-file encoders do."""
    whole = vocabulary.ranks.get(data)
    return [whole] if whole is not None else Prefixes(vocabulary, data).ids()


class Encoder:
    """Encodes and decodes texts: each match of the pattern on its own."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = Vocabulary(ranks)
        self.packed = Memo(lambda piece: np.array(encode_piece(self.vocabulary, piece.encode()), "<u4").tobytes(), KEPT_PACKED)
        self.listed = Memo(lambda piece: b",".join(b"%d" % t for t in encode_piece(self.vocabulary, piece.encode())), KEPT_LISTED)
        self.bytes_of = {b"%d" % rank: token for rank, token in self.vocabulary.tokens.items()}

    def encode_listed(self, text: str) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return b",".join(map(self.listed.__getitem__, pieces(text)))

    def decode_listed(self, listed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, listed.split(b","))) if listed else b""

    def encode_packed(self, text: str) -> np.ndarray:
        """The ids as an array."""
        return np.frombuffer(b"".join(map(self.packed.__getitem__, pieces(text))), "<u4")

    def encode(self, text: str) -> list[int]:
        return self.encode_packed(text).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.vocabulary.tokens[i] for i in ids)


class EditedText:
    """A text with its pieces, encoded anew only near its edits."""

    def __init__(self, encoder: Encoder, text: str = "", pattern: str = public_tokenizers.PATTERN):
        self.encoder, self.pattern, self.text = encoder, regex.compile(pattern), text
        self.found = self.pattern.findall(text)
        self.tables = [Prefixes(encoder.vocabulary, p.encode()) for p in self.found]

    def edit(self, start: int, stop: int, put: str) -> int:
        """Replaces characters start to stop; returns how many pieces were encoded anew. A match depends on two characters beyond its end at most."""
        text, shift = self.text[:start] + put + self.text[stop:], len(put) - (stop - start)
        kept, at = 0, 0
        while kept < len(self.found) and at + len(self.found[kept]) + 2 <= start:
            at += len(self.found[kept])
            kept += 1
        ends, place = {}, 0
        for k, piece in enumerate(self.found):
            ends[place] = k
            place += len(piece)
        ends[place] = len(self.found)
        fresh, here = [], at
        for match in self.pattern.finditer(text, at):
            here = match.start()
            if here >= start + len(put) and here - shift in ends:
                break
            fresh.append(match.group())
            here = match.end()
        rest = ends.get(here - shift, len(self.found)) if here >= start + len(put) else len(self.found)
        self.tables[kept:rest] = [Prefixes(self.encoder.vocabulary, p.encode()) for p in fresh]
        self.found[kept:rest], self.text = fresh, text
        return len(fresh)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        ranks = self.encoder.vocabulary.ranks
        return [i for t in self.tables for i in ([ranks[t.data]] if t.data in ranks else t.ids())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and rank file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text).

    Null texts count as empty and have no ids. Rows are independent, so ties, repeated rows and null ids need no rule,
    and an empty table gives an empty result. A long text is held once, with its ids, in one task.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("text"):
                listed = own.encode_listed(text.as_py() or "")
                counts.append(listed.count(b",") + bool(listed))
                ids.append(_sha(listed))
                decoded.append(_sha(own.decode_listed(listed)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidied(rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """docs with two more columns, token_ids (array of int) and n_tokens; columns of these names are replaced. Null texts have no ids."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    base = docs.drop("token_ids", "n_tokens")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["token_ids array<int>", "n_tokens long"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode_packed(text.as_py() or "") for text in batch.column("text")]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(np.diff(ends), pa.int64())]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=[*batch.schema.names, "token_ids", "n_tokens"])

    return base.mapInArrow(tidied(rows), schema)
