"""Near-duplicate lines across documents, by a segment-partition edit join.

Two lines link if at most EDITS insertions, deletions or substitutions of characters turn one into the other. A line is
cut into EDITS + 1 segments; a line within EDITS of it must contain one of them unchanged, near its place. So each line
is indexed by (length, segment number, segment), and probes the lengths from its own down to EDITS less with the few
substrings that can match (bounds from the left and from the right of each segment). Banded bit-parallel edit distance
verifies the pairs of lines whose keys meet.

With edits=None the bound grows with the line (the registered query and the pipeline, over all lines that aren't blank):
0 edits below 20 characters of the shorter line, 1 below 40, then 2; lines of 40 and more also link if at most one in
SHARE of the longer one's words is inserted, deleted or replaced. Where that is one word, lines are cut into two segments
of words. Beyond, probes would grow as the cube of the edits; such a line posts its rarest pairs of neighbouring words
instead, as many as the edits can break and one more, so two lines that link share one, at about the same place. A sketch
of all pairs gives the order; any order finds every link. From WORDY words on these keys also find what EDITS edits of
characters leave alike. A letter of a script written without blanks is a word.

Keys of up to POSTED lines yield their pairs. A more frequent key first yields a chain, in which each line meets its next
CHAIN ones. Then the frequent keys that have lines of several classes make up bundles, with all lines of these classes that
have such a key: two lines of one key are in one bundle. The lines of a bundle, once each and as numbers and histograms of
characters and words, are compared with those of other classes, and pairs whose histograms leave room for a link are verified
there, unless the task has connected them. A bundle of more than PART lines is compared by its keys instead, in tiles of
PART by PART lines, a pair at one of its common keys only. So copies in great numbers cost a chain, and no link is lost.

Linked lines form classes. The occurrence of a class with the smallest (doc_id, line number) stays, all others go. Lines
are told apart by two 64-bit hashes.

Scale: only hashes move for all lines, about 14 bytes for each key, packed by the first bits of the keys, and keys that one line alone has
end where they arrive; a line has up to 21 keys when it is short, and one for
five words when it is long. Texts move only for lines whose keys meet another's. Equal lines are one line from the start, so
a line that a third of all documents share costs no more.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm import sketch
from folia.llm.common import BLANKS, column, components, small, tidied, written
from folia.llm.line_keys import ANYWHERE, EDITS, LEAST_CHARS, SHARE, Chunk, bound, keys, pair_hashes, slack, worded

#: Lines of a key up to which all its pairs are made, and the next ones that a line of a more frequent key meets in its chain.
POSTED, CHAIN = 32, 4
#: Lines of a frequent key or of a bundle of them that meet in one task, and rows of numbers up to which a side is broadcast.
PART, FILTERED = 20_000, 500_000
#: Characters whose keys are made at once, rows of keys that are gathered before they are paired, and pairs of lines that are compared at once.
CHUNK, GATHERED, CELLS = 200_000, 100_000, 1 << 18
#: Slots that keys are dealt to by their first 12 bits; the next 32 tell them apart within one. Rows of keys that a task packs at once.
SLOTS, PACKED = 1 << 12, 1 << 19
LINKS = "a long, check_a long, b long, check_b long"
#: Buckets of the histograms of characters and words.
CHARS, WORDS = 16, 128

_WORDS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|[^\x20\x09-\x0d\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def edit_distance(a: str | tuple, b: str | tuple, most: int) -> int:
    """The edit distance of a and b, or most + 1 if it is greater. Bit-parallel over a band of 2 * most + 1 diagonals."""
    most = int(most)  # the masks below need whole numbers of any size
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, stop = 0, min(len(a), len(b))
    if a == b:
        return 0
    step = 64  # common ends are skipped by pieces, then by characters
    while start < stop and a[start : start + step] == b[start : start + step] and start + step <= stop:
        start += step
    while start < stop and a[start] == b[start]:
        start += 1
    end, room = 0, stop - start
    while end + step <= room and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
        end += step
    while end < room and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    if min(n, m) <= most:
        return _plain(a, b, most)
    k, width = most, 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (2 * most)
    places: dict[str, int] = defaultdict(int)
    for row, c in enumerate(b):
        places[c] |= 1 << row
    vp, vn, dist = ((1 << (k + 1)) - 1) << k, 0, k
    for j in range(1, n + 1):
        full, shift = places.get(a[j - 1], 0), j - k - 1
        match = (full >> shift if shift >= 0 else full << -shift) & mask
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j + k <= m:  # down the lowest diagonal of the band, then along the last row
            dist += not d0 & top
        else:
            bit = 1 << (m - j + k)
            dist += bool(hp & bit) - bool(hn & bit)
        if dist > most + 2 * k:
            return most + 1
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
    return min(dist, most + 1)


def _plain(a: str, b: str, most: int) -> int:
    """By rows, for strings of which one is no longer than the band."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


def index_keys(line: str, edits: int | None = EDITS) -> list[int]:
    """The keys under which a line is indexed by its segments."""
    key, _, info = keys([line], edits, np.zeros(1 << sketch.BITS, dtype=np.uint32) if edits is None else None)
    return key[info == 0].tolist()


def probe_keys(line: str, edits: int | None = EDITS) -> list[int]:
    """The keys under which lines of at most this length within the edits are indexed, one of them at least for each."""
    key, _, info = keys([line], edits, np.zeros(1 << sketch.BITS, dtype=np.uint32) if edits is None else None)
    return key[info == 1].tolist()


def line_words(line: str) -> list[str]:
    return _WORDS.findall(line)


def links(x: str, y: str, edits: int | None = EDITS, split=line_words) -> bool:
    """Whether two lines link. split: line_words, or one that keeps its answers."""
    least, most = min(len(x), len(y)), int(bound(min(len(x), len(y)), edits))
    if edits is not None or least < LEAST_CHARS:
        return edit_distance(x, y, most) <= most
    a, b = split(x), split(y)
    many = max(len(a), len(b)) // SHARE
    if many and len(a) == len(b) and sum(map(ne, a, b)) <= many:  # replaced words alone, the most frequent case
        return True
    return edit_distance(x, y, most) <= most or (many > 0 and edit_distance(tuple(a), tuple(b), many) <= many)


def _distinct(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[int], list[str]]]:
    """The distinct lines of a task, as many at a time as make up CHUNK characters, and their numbers."""
    seen: set[int] = set()
    nodes, lines, held = [], [], 0
    for batch in batches:
        for text in batch.column("text"):
            for line in (text.as_py() or "").split("\n"):
                if len(line) < least or not line.strip(BLANKS):
                    continue
                node = xxhash.xxh64_intdigest(line.encode(), seed=42)
                if node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                lines.append(line)
                held += len(line)
                if held >= CHUNK:
                    yield nodes, lines
                    nodes, lines, held = [], [], 0
    if lines:
        yield nodes, lines


def _counted(least: int):
    """The pieces of a task's counts of pairs of words in lines that meet by them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sketch.Counter()
        for _, lines in _distinct(batches, max(least, LEAST_CHARS)):
            chunk = Chunk(lines)
            counter.add(pair_hashes(chunk, worded(chunk))[0])
        pieces = counter.pieces()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], names=["piece", "counts"])

    return rows


def _keyed(edits: int | None, least: int, shared):
    """The keys of a task's distinct lines with their nodes and infos, packed by slot. info is 0 for index keys, 1 for probes, and from 2 on for pairs of words (words << 16 | place) + 2."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, n = shared.value if shared is not None else None, [], 0
        for nodes, lines in _distinct(batches, least if edits is not None else max(least, 1)):
            key, line, info = keys(lines, edits, counts)
            waiting.append((key, np.array(nodes, dtype=np.uint64).view(np.int64)[line], info))
            n += len(key)
            if n >= PACKED:
                yield _packed(*map(np.concatenate, zip(*waiting)))
                waiting, n = [], 0
        if n:
            yield _packed(*map(np.concatenate, zip(*waiting)))

    return rows


def _packed(key: np.ndarray, node: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
    """A row (slot, low, node, info) for each slot: the bytes of 32 bits of its keys, of their nodes, and of their infos by planes, of which most are empty."""
    key = key.view(np.uint64)
    order = np.argsort(key)
    key, node, info = key[order], node[order], info[order]
    low = ((key >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    edges = np.searchsorted((key >> np.uint64(52)).astype(np.int32), np.arange(SLOTS + 1, dtype=np.int32))
    slot = np.flatnonzero(edges[1:] > edges[:-1])
    ends = list(zip(edges[slot].tolist(), edges[slot + 1].tolist()))
    planes = info.view(np.uint8).reshape(-1, 8)
    blocks = [low[s:e].tobytes() for s, e in ends], [node[s:e].tobytes() for s, e in ends], [planes[s:e].T.tobytes() for s, e in ends]
    return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *[pa.array(x, pa.binary()) for x in blocks]], names=["slot", "low", "node", "info"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of _packed sorted by slot: (key, node, info) of the keys that more than one row has, sorted by them, a slot at a time."""

    def whole(slot, blocks):
        low, node, planes = zip(*blocks)
        low, node = np.frombuffer(b"".join(low), np.uint32), np.frombuffer(b"".join(node), np.int64)
        order = np.argsort(low)
        same = low[order][1:] == low[order][:-1]
        pick = order[np.r_[same, False] | np.r_[False, same]] if len(order) > 1 else order[:0]
        info = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in planes])[pick]
        low, node = low[pick], node[pick]
        order = np.lexsort((node, info, low))
        return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (low.astype(np.int64) | slot << 32, node, info)], names=["key", "node", "info"])

    now, blocks = None, []
    for batch in batches:
        for slot, *block in zip(*[batch.column(c).to_pylist() for c in ("slot", "low", "node", "info")]):
            if slot != now:
                if blocks:
                    yield whole(now, blocks)
                now, blocks = slot, []
            blocks.append(block)
    if blocks:
        yield whole(now, blocks)


def _may_link(info_a, info_b):
    """Whether rows of a key can be of lines that link: segments always, pairs of words by the number of words and their places in them."""
    m_a, m_b, at_a, at_b = (info_a - 2) >> 16, (info_b - 2) >> 16, (info_a - 2) & ANYWHERE, (info_b - 2) & ANYWHERE
    most = slack(np.maximum(m_a, m_b))
    near = (np.abs(at_a - at_b) <= most) & (np.abs((m_a - at_a) - (m_b - at_b)) <= most)
    return (info_a < 2) | ((np.abs(m_a - m_b) <= most) & (near | (at_a == ANYWHERE) | (at_b == ANYWHERE)))


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of batches, GATHERED rows or more at a time."""
    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            n += batch.num_rows
        if n >= GATHERED:
            yield [np.concatenate(x) for x in zip(*waiting)]
            waiting, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*waiting)]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From keys sorted by (key, info, node): pairs (a, b) of lines that may link, and for keys of more than POSTED rows chains and the rows (a, key, info) themselves."""
    names = ["key", "node", "info"]
    held, old = [np.zeros(0, dtype=np.int64)] * 3, 0  # rows of a key that goes on; of a frequent one the last rows, of which `old` have been given out

    def out(found, rows=None):
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        n, (key, node, info) = len(pairs), rows or [pairs[:0, 0]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[pairs[:, 0], node]), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(node), pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(info)])],
            names=["a", "b", "key", "info"],
        )

    def paired(node, i, j):
        low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return np.stack([low, high], 1)[low != high]

    def few(key, node, info):
        """All pairs of keys of up to POSTED rows."""
        found = []
        for d in range(1, POSTED):
            i = np.flatnonzero(key[:-d] == key[d:]) if len(key) > d else key[:0]
            if not len(i):
                break
            ok = ((info[i] != 0) | (info[i + d] == 1)) & ((info[i] != 1)) & _may_link(info[i], info[i + d])
            found.append(paired(node, i[ok], i[ok] + d))
        return out(found)

    def many(rows, given):
        """The chain of rows of frequent keys, all but the first `given` of them new."""
        key, node, info = rows
        found = []
        for d in range(1, CHAIN + 1):
            i = np.flatnonzero((key[:-d] == key[d:]) & _may_link(info[:-d], info[d:])) if len(key) > d else key[:0]
            found.append(paired(node, i[i + d >= given], i[i + d >= given] + d))
        return out(found, [x[given:] for x in rows])

    def whole(rows):
        key = rows[0]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        size = np.repeat(sizes, sizes)
        if (pick := (size > 1) & (size <= POSTED)).any():
            yield few(*[x[pick] for x in rows])
        if (pick := size > POSTED).any():
            yield many([x[pick] for x in rows], 0)

    for now in _gathered(batches, names):
        if old:
            more = int(np.searchsorted(now[0], held[0][0], "right"))
            rows = [np.concatenate([h, x[:more]]) for h, x in zip(held, now)]
            if more:
                yield many(rows, old)
            now = [x[more:] for x in now]
            if not len(now[0]):
                held = [x[-CHAIN:] for x in rows]
                old = len(held[0])
                continue
            held, old = [x[:0] for x in held], 0
        now = [np.concatenate([h, x]) for h, x in zip(held, now)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield from whole([x[:cut] for x in now])
        held = [x[cut:] for x in now]
        if len(held[0]) > POSTED:
            yield many(held, 0)
            held = [x[-CHAIN:] for x in held]
            old = len(held[0])
    if not old and len(held[0]):
        yield from whole(held)


def _verified(edits: int | None):
    """The links among pairs of lines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([links(x, y, edits) for x, y in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "check_a", "b", "check_b")], names=["a", "check_a", "b", "check_b"])

    return rows


def shapes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of characters and of words of lines, and histograms of both: one edit moves each by 2 at most."""
    chunk = Chunk(lines)
    codes = np.concatenate([chunk.codes, np.zeros(1, dtype=chunk.codes.dtype)])  # so that each line has an end of its own
    out = np.zeros((len(lines), CHARS + WORDS), dtype=np.uint8)
    of_chars = np.repeat(np.arange(len(lines)), chunk.n + 1) * CHARS + ((codes * np.uint32(0x9E3779B1)) >> np.uint32(28))
    kept = np.ones(len(codes), dtype=bool)
    kept[chunk.at + chunk.n] = False
    of_words = np.repeat(np.arange(len(lines)), chunk.m) * WORDS + (chunk.words % np.uint64(WORDS)).astype(np.int64)
    out[:, :CHARS] = np.minimum(np.bincount(of_chars[kept], minlength=len(lines) * CHARS), 255).reshape(-1, CHARS)
    out[:, CHARS:] = np.minimum(np.bincount(of_words, minlength=len(lines) * WORDS), 255).reshape(-1, WORDS)
    return chunk.n, chunk.m, out


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n, m, found = shapes(batch.column("line").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n), pa.array(m), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "n", "m", "shape"])


def _shapes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, CHARS + WORDS)


def _apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the histograms of characters and of words are apart."""
    gap = np.maximum(x, y) - np.minimum(x, y)
    return gap[:, :CHARS].sum(1, dtype=np.int32), gap[:, CHARS:].sum(1, dtype=np.int32)


def _room(n_a, n_b, m_a, m_b, apart, edits: int | None):
    """Whether sizes and the differences of histograms leave room for a link."""
    least, most = np.minimum(n_a, n_b), np.maximum(m_a, m_b) // SHARE
    few = bound(least, edits)
    ok = (np.abs(n_a - n_b) <= few) & (apart[0] <= 2 * few)
    if edits is None:
        ok |= (least >= LEAST_CHARS) & (np.abs(m_a - m_b) <= most) & (apart[1] <= 2 * most)
    return ok


def _roomy(edits: int | None):
    """The pairs whose histograms leave room for a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b", "m_a", "m_b")]
            ok = pa.array(_room(*sizes, _apart(_shapes(batch.column("shape_a")), _shapes(batch.column("shape_b"))), edits))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return rows


def _compared(edits: int | None):
    """Links from tiles (key, i, j) of the rows of a frequent key, sorted by tile and info: between lines of different classes whose histograms leave room. Lines that a tile has connected aren't compared again, and of the frequent keys that may link a pair only the smallest compares it."""

    def compare(key, columns, texts, own, across):
        node, check, info, part, group, n, m, found = columns
        up: dict[int, int] = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def first_key(x, y):
            shared, i, j = np.intersect1d(x[0], y[0], return_indices=True)
            return shared[_may_link(x[1][i], y[1][j])][0]

        out, x = [], 0
        while x < len(node) - 1:
            end = len(node)
            rows = max(1, CELLS // (end - x))
            if info[x] >= 2:  # sorted by words: no link reaches further
                end = int(np.searchsorted(m, m[min(x + rows, end) - 1] * SHARE // (SHARE - 1) + 5))
            i, j = np.meshgrid(np.arange(x, min(x + rows, end)), np.arange(x + 1, end), indexing="ij")
            ok = (j > i) & (group[i] != group[j]) & (node[i] != node[j])
            if across:
                ok &= part[i] != part[j]
            i, j = i[ok], j[ok]
            ok = _may_link(info[i], info[j])
            i, j = i[ok], j[ok]
            for s in range(0, len(i), CELLS // WORDS):
                a, b = i[s : s + CELLS // WORDS], j[s : s + CELLS // WORDS]
                ok = _room(n[a], n[b], m[a], m[b], _apart(found[a], found[b]), edits)
                for k, l in zip(a[ok].tolist(), b[ok].tolist()):  # noqa: E741
                    one, other = root(int(group[k])), root(int(group[l]))
                    if one != other and first_key(own[k], own[l]) == key and links(texts[k], texts[l], edits):
                        up[one] = other
                        out.append((k, l))
            x += rows
        k, l = np.array(out, dtype=np.int64).reshape(-1, 2).T  # noqa: E741
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[k], check[k], node[l], check[l])], names=["a", "check_a", "b", "check_b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, texts, own = None, [], [], []

        def done():
            return compare(tile[0], [np.concatenate([h[c] for h in held]) for c in range(8)], texts, own, tile[1] != tile[2])

        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "node", "check", "info", "part", "group", "n", "m")]
            found, lines, tiles = _shapes(batch.column("shape")), batch.column("line"), np.stack(numbers[:3], 1)
            lists = [batch.column(c) for c in ("keys", "infos")]
            starts, flat = lists[0].offsets.to_numpy(), [x.values.to_numpy(zero_copy_only=False) for x in lists]
            edges = np.r_[0, np.flatnonzero((tiles[1:] != tiles[:-1]).any(1)) + 1, len(tiles)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if low == high:
                    continue
                if held and tuple(tiles[low]) != tile:
                    yield done()
                    held, texts, own = [], [], []
                tile = tuple(tiles[low])
                held.append([x[low:high] for x in numbers[3:]] + [found[low:high]])
                texts += lines[low:high].to_pylist()
                own += [[x[starts[k] : starts[k + 1]] for x in flat] for k in range(low, high)]
        if held:
            yield done()

    return rows


def _bundled(edits: int | None):
    """Links from the rows of bundles, sorted by bundle and words: between lines of different classes whose histograms leave room. Lines that a bundle has connected aren't compared again. With each link come the classes of its ends and the smallest that the bundle has joined to them."""

    def compare(columns, texts):
        node, check, group, n, m, found = columns
        up, split = {}, functools.cache(line_words)

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        out, x = [], 0
        while x < len(node) - 1:
            rows = max(1, CELLS // (len(node) - x))
            end = len(node)
            if edits is None:  # sorted by words: no link reaches further
                end = int(np.searchsorted(m, m[min(x + rows, end) - 1] * SHARE // (SHARE - 1) + 5))
            one, other = slice(x, min(x + rows, len(node))), slice(x + 1, end)
            ok = (group[one, None] != group[other]) & _room(n[one, None], n[other], m[one, None], m[other], (0, 0), edits)  # by sizes first
            i, j = np.nonzero(np.triu(ok))
            i, j = i + x, j + x + 1
            for s in range(0, len(i), CELLS // WORDS):
                a, b = i[s : s + CELLS // WORDS], j[s : s + CELLS // WORDS]
                ok = _room(n[a], n[b], m[a], m[b], _apart(found[a], found[b]), edits)
                for k, l in zip(a[ok].tolist(), b[ok].tolist()):  # noqa: E741
                    one, other = root(int(group[k])), root(int(group[l]))
                    if one != other and links(texts[k], texts[l], edits, split):
                        up[one] = other
                        out.append((k, l))
            x += rows
        k, l = np.array(out, dtype=np.int64).reshape(-1, 2).T  # noqa: E741
        least: dict[int, int] = {}
        for x in {*group[k].tolist(), *group[l].tolist()}:
            least[root(x)] = min(x, least.get(root(x), x))
        joined = np.array([least[root(x)] for x in group[k].tolist()], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[k], check[k], node[l], check[l], group[k], group[l], joined)], names=["a", "check_a", "b", "check_b", "group_a", "group_b", "class"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, texts = None, [], []
        for batch in batches:
            bundle, *numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bundle", "node", "check", "group", "n", "m")]
            found, lines = _shapes(batch.column("shape")), batch.column("line")
            edges = np.r_[0, np.flatnonzero(bundle[1:] != bundle[:-1]) + 1, len(bundle)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if low == high:
                    continue
                if held and bundle[low] != now:
                    yield compare([np.concatenate(x) for x in zip(*held)], texts)
                    held, texts = [], []
                now = bundle[low]
                held.append([x[low:high] for x in numbers] + [found[low:high]])
                texts += lines[low:high].to_pylist()
        if held:
            yield compare([np.concatenate(x) for x in zip(*held)], texts)

    return rows


def numbered(line: Column) -> tuple[Column, Column]:
    """The number of a line, and a second hash: what tells lines apart."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _taking_part(docs: DataFrame, least: int, *more: Column) -> DataFrame:
    """number, line and more columns for the lines of docs that take part."""
    lines = docs.select(*more, F.posexplode(F.split("text", "\n")).alias("number", "line")).where(F.ltrim("line", F.lit(BLANKS)) != "")
    return lines.where(F.length("line") >= least) if least > 1 else lines


def _by_keys(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The tiles of frequent keys, from rows (key, node, info, group, parts) and lines (node, check, line, n, m, shape)."""
    posts = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "info"))).alias("_")).select("node", F.col("_.key").alias("keys"), F.col("_.info").alias("infos"))
    tiles = rows.join(lines.join(posts, "node"), "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    return tiles.select("key", "i", "j", "node", "check", "info", "part", "group", "n", "m", "shape", "keys", "infos", "line").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "info", "node")


def classes(docs: DataFrame, edits: int | None = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(node, check, class) of the lines that link with another line, from docs (doc_id, text)."""
    spark, texts, shared = docs.sparkSession, docs.select("text"), None
    if edits is None:
        shared = spark.sparkContext.broadcast(sketch.total(texts.mapInArrow(tidied(_counted(least)), "piece int, counts binary")))
    posted = texts.mapInArrow(tidied(_keyed(edits, least, shared)), "slot int, low binary, node binary, info binary").repartition("slot").sortWithinPartitions("slot")
    met = written(posted.mapInArrow(tidied(lambda batches: _met(_shared(batches))), "a long, b long, key long, info long"), "lines-met", "zstd")
    pairs = written(met.where("key is null").select("a", "b").distinct(), "lines-pairs")
    frequent = met.where("key is not null").select("key", F.col("a").alias("node"), "info")
    wanted = written(pairs.select("a").union(pairs.select("b")).union(frequent.select("node")).distinct().select(F.col("a").alias("node")), "lines-wanted")
    node, check = numbered(F.col("line"))
    lines = _taking_part(texts, least).select(node.alias("node"), check.alias("check"), "line").join(small(wanted, FILTERED), "node")
    lines = written(lines.groupBy("node").agg(F.min(F.struct("check", "line")).alias("_")).select("node", "_.*"), "lines-texts", "zstd")
    shaped = written(lines.select("node", "line").mapInArrow(tidied(_shaped), "node long, n long, m long, shape binary"), "lines-shapes", "zstd")
    one, other = (shaped.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "m", "shape")]) for k in "ab")
    roomy = written(pairs.join(one, "a").join(other, "b").mapInArrow(tidied(_roomy(edits)), "a long, b long"), "lines-roomy")
    needed = lines.join(small(written(roomy.select("a").union(roomy.select("b")).distinct().select(F.col("a").alias("node")), "lines-needed"), FILTERED), "node", "left_semi")
    first, second = (needed.select(F.col("node").alias(k), F.col("check").alias(f"check_{k}"), F.col("line").alias(f"line_{k}")) for k in "ab")
    both = roomy.join(first, "a").join(second, "b").select("a", "check_a", "line_a", "b", "check_b", "line_b")
    linked = written(both.mapInArrow(tidied(_verified(edits)), LINKS), "lines-links")
    near = written(components(linked.select("a", "b"), "lines-near").withColumnRenamed("component", "group"), "lines-groups")
    joint = None
    if frequent.limit(1).count():
        rows = written(frequent.join(small(near, FILTERED), "node", "left").withColumn("group", F.coalesce("group", "node")), "lines-frequent")
        groups = written(rows.groupBy("key", "group").agg(F.count("*").alias("n")), "lines-classes")
        open_keys = groups.groupBy("key").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").select("key", "parts")
        open_keys = written(open_keys, "lines-open")
        edges = groups.join(small(open_keys), "key", "left_semi").select(F.col("key").alias("a"), F.col("group").alias("b"))
        bundles = written(components(edges, "lines-keys").select(F.col("node").alias("key"), F.col("component").alias("bundle")).join(small(open_keys), "key"), "lines-bundles")
        rows = written(rows.join(small(bundles, FILTERED), "key"), "lines-compared")
        members = written(rows.select("bundle", "node", "group").distinct(), "lines-members")
        large = written(members.groupBy("bundle").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("bundle"), "lines-large")
        named = small(written(members.select("node"), "lines-named"), FILTERED)
        full = lines.join(named, "node", "left_semi").join(shaped.join(named, "node", "left_semi"), "node")
        members = members.join(small(large), "bundle", "left_anti")
        whole = members.join(full, "node").select("bundle", "node", "check", "group", "n", "m", "shape", "line").repartition("bundle").sortWithinPartitions("bundle", "m", "node")
        late = written(whole.mapInArrow(tidied(_bundled(edits)), f"{LINKS}, group_a long, group_b long, class long"), "lines-late")
        joint = late.select(F.col("group_a").alias("group"), "class").union(late.select("group_b", "class"))
        linked = linked.union(late.select(linked.columns))
        if large.limit(1).count():
            late = written(_by_keys(rows.join(small(large), "bundle", "left_semi"), full).mapInArrow(tidied(_compared(edits)), LINKS), "lines-late")
            one, other = (near.select(F.col("node").alias(k), F.col("group").alias(f"group_{k}")) for k in "ab")
            met = late.join(small(one, FILTERED), "a", "left").join(small(other, FILTERED), "b", "left").select(F.coalesce("group_a", "a").alias("a"), F.coalesce("group_b", "b").alias("b"))
            joint = joint.union(components(met, "lines-joint"))
            linked = linked.union(late)
        joint = written(joint.distinct(), "lines-joint")
    ends = linked.select(F.col("a").alias("node"), F.col("check_a").alias("check")).union(linked.select("b", "check_b")).distinct()
    ends = ends.join(small(near, FILTERED), "node", "left").select("node", "check", F.coalesce("group", "node").alias("group"))
    if joint is None:
        return ends.withColumnRenamed("group", "class")
    return ends.join(small(joint, FILTERED), "group", "left").select("node", "check", F.coalesce("class", "group").alias("class"))


def dropped(docs: DataFrame, edits: int | None = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_id (xxhash64 of the text) and gone, an array of struct(block, bits): bit k of a block stands for line 64 * block + k of that text, which goes."""
    node, check = numbered(F.col("line"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")  # hashed once a text, not once a line
    occurring = _taking_part(texts, least, F.col("doc_id"), F.col("text_id")).select("doc_id", "text_id", "number", node.alias("node"), check.alias("check"))
    occurring = written(occurring, "lines-occurring", "zstd")
    linked = written(classes(docs.select("doc_id", "text"), edits, least), "lines-linked")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_id", "number")
    named = occurring.join(small(linked, FILTERED), ["node", "check"], "left")
    named = named.select("doc_id", "text_id", "number", place.alias("place"), F.coalesce("class", "node").alias("class"), F.when(F.col("class").isNull(), F.col("check")).otherwise(0).alias("alone"))
    again = written(named.groupBy("class", "alone").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "lines-again")
    named = written(named.join(small(again, FILTERED), ["class", "alone"]), "lines-repeated", "zstd")
    first = written(named.groupBy("class", "alone").agg(F.min("place").alias("first")), "lines-first")
    rows = named.select("doc_id", "text_id", "number", F.lit(False).alias("stays")).union(first.select("first.doc_id", "first.text_id", "first.number", F.lit(True)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)
    bits = rows.groupBy("doc_id", "text_id", F.floor(F.col("number") / 64).cast("int").alias("block")).agg(*[F.coalesce(F.bit_or(F.when(F.col("stays") == which, bit)), F.lit(0).cast("long")).alias(name) for which, name in ((False, "all"), (True, "stay"))])
    bits = bits.select("doc_id", "text_id", "block", F.col("all").bitwiseAND(F.bitwise_not("stay")).alias("bits")).where("bits <> 0")
    return written(bits.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("block", "bits")).alias("gone")), "lines-dropped")


def without_repeats(docs: DataFrame, edits: int | None = EDITS, least: int = LEAST_CHARS, counts: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text; with counts also n_lines and n_dropped.

    Every line counts in full, however long; lines of fewer than least characters (none with least=1) and blank ones always stay. A text that
    loses all its lines becomes empty and its row stays. Null and empty texts stay as they are. Rows with a null doc_id come
    after all others. Rows that share a doc_id and a text are one document and lose the same lines; of different texts that
    share a doc_id one comes first, the same in every run. An empty table gives an empty result. Other columns pass through.
    """
    gone = dropped(docs.select("doc_id", "text"), edits, least).select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), F.map_from_entries("gone").alias("_gone"))
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_text_id"))
    joined = packed.join(small(gone, weight=F.size("_gone")), same, "left").withColumn("_all", F.split("_text", "\n"))
    left = F.filter("_all", lambda _, i: F.coalesce(F.bit_get(F.element_at("_gone", F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0)
    joined = joined.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("_all")).otherwise(left))
    columns = [F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join("_left", "\n")).alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    if counts:
        sizes = F.coalesce(F.size("_all"), F.lit(0)), F.coalesce(F.size("_all") - F.size("_left"), F.lit(0))
        columns += [F.when(F.col("_text").isNull(), 0).otherwise(x).cast("long").alias(name) for name, x in zip(("n_lines", "n_dropped"), sizes)]
    return joined.select(*columns)


def line_digests(docs: DataFrame, edits: int | None = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256 (of the text that is left, null as empty) for every row of docs."""
    out = without_repeats(docs.select("doc_id", "text"), edits, least, counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
