"""N-gram Jaccard join: documents whose sets of word shingles are similar, and the groups they form.

1. Each text becomes a set of 64-bit shingle hashes. Equal sets are joined by a 128-bit fingerprint at once, so copies
   cost nothing further. The same pass counts shingles in a sketch of fixed size over all documents.
2. Rare-first prefixes: a set's shingles are ordered by (sketched count, hash), and only the first n - ceil(0.8 n) + 1
   are posted. Any fixed order finds every link; a good one keeps postings short.
3. A shingle posted by up to POSTED sets yields their pairs that pass the length and positional filters, each pair once,
   and the suffix filter: a lower bound of the symmetric difference from the sets' histograms over the hash space. A
   shingle posted by more yields a star, so no group emits all its pairs. Pairs and stars together are connected to
   blocks: every link lies within one block.
4. Each block, or each pair of parts of a large block, is joined in one task: prefixes by exact counts in the block,
   length filter, suffix filter, then the exact overlap, once per pair and only between sets not yet connected.
5. The links found form a spanning forest of each group; its components are the groups.

Scale: texts are read three times, the third time only those in blocks move. Memory of a task is bounded by the sketch
and by PART sets of a block. The sketch, the prefixes and the suffix filter change the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import sketch
from folia.llm.common import column, components, small, tidied, written

#: Words in a shingle, and the similarity from which documents link, in hundredths.
WORDS, PERCENT = 5, 80
#: Sets that may post a shingle before it yields a star in place of pairs, and sets of a block that meet in one task.
POSTED, PART = 32, 1500

#: Fixed odd multipliers for the words of a shingle, and a constant for each number of words below five.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_SHORT = np.array([0, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; the words of a shorter text are one shingle."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    if n < WORDS:
        return _mixed((hashes * _FACTORS[:n]).sum(keepdims=True) + _SHORT[n : n + 1])
    m = n - WORDS + 1
    total = np.zeros(m, dtype=np.uint64)
    for k in range(WORDS):
        total += hashes[k : k + m] * _FACTORS[k]
    return np.unique(_mixed(total))


def least_overlap(a, b):
    """The least common size of two sets of sizes a and b that link."""
    return -(-(PERCENT * (a + b)) // (100 + PERCENT))


def prefix_length(n):
    return n - -(-(PERCENT * n) // 100) + 1


def histogram(found: np.ndarray) -> np.ndarray:
    """Counts over the hash space, up to 255 each, in about n / 8 parts, a power of two."""
    parts = min(12, max(4, int(len(found) // 8).bit_length()))
    return np.minimum(np.bincount((found >> np.uint64(64 - parts)).astype(np.int64), minlength=1 << parts), 255).astype(np.uint8)


def may_link(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """The suffix filter: whether the histograms leave room for a link."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.abs(x - y).sum()) <= n_a + n_b - 2 * least_overlap(n_a, n_b)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the pieces of the task's counts. Copies count once in a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sig", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])
    counter, seen = sketch.Counter(), set()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = shingles(text.as_py())
            digest = xxhash.xxh3_128_digest(found.tobytes())
            hi, lo = np.frombuffer(digest, "<i8").tolist()
            rows.append((doc_id, len(found), hi, lo, histogram(found).tobytes() if len(found) else None))
            if (hi, lo) not in seen:
                seen.add((hi, lo))
                counter.add(found)
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)] + [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema=schema)
    if pieces := counter.pieces():
        n = len(pieces)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in list(schema)[:5]] + [pa.array([k for k, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], schema=schema)


def _posted(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            tokens, los, ns, places = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                hi, lo = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist()
                if not len(found) or (hi, lo) in seen:
                    continue
                seen.add((hi, lo))
                n, k = len(found), prefix_length(len(found))
                known = np.minimum(counts[sketch.places(found)], (1 << 23) - 1).astype(np.uint64)
                first = np.argsort((known << np.uint64(40)) | (found >> np.uint64(24)), kind="stable")[:k]
                tokens.append(found[first].view(np.int64))
                los.append(np.full(k, lo))
                ns.append(np.full(k, n, dtype=np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, los, ns, places)], names=["token", "lo", "n", "place"])

    return rows


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs or stars (a, b, star) from postings sorted by token; rows of a posting may lie in several batches."""
    names = ["token", "lo", "n", "place"]
    held = [np.zeros(0, dtype=np.int64)] * 4
    star = None  # token and center of a star whose rows go on

    def out(a, b, is_star):
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], 1)[low != high], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), is_star))], names=["a", "b", "star"])

    def work(token, lo, n, place):
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        size = np.repeat(sizes, sizes)
        big = size > POSTED
        if big.any():
            centers = np.repeat(lo[starts], sizes)
            yield out(centers[big], lo[big], True)
        token, lo, n, place, size = (x[(size > 1) & ~big] for x in (token, lo, n, place, size))
        found_a, found_b = [], []
        for d in range(1, POSTED):
            i = np.flatnonzero(token[:-d] == token[d:]) if len(token) > d else np.zeros(0, dtype=np.int64)
            if not len(i):
                break
            j = i + d
            least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            room = np.minimum(n[i] - place[i], n[j] - place[j])
            ok = (100 * least >= PERCENT * most) & (room >= least_overlap(n[i], n[j]))
            found_a.append(lo[i[ok]])
            found_b.append(lo[j[ok]])
        if found_a:
            yield out(np.concatenate(found_a), np.concatenate(found_b), False)

    for batch in batches:
        now = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, names)]
        if star is not None and len(now[0]):
            more = now[0] == star[0]
            if more.any():
                yield out(np.full(int(more.sum()), star[1]), now[1][more], True)
            now = [x[~more] for x in now]
            if len(now[0]):
                star = None
        if not len(now[0]):
            held = now
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[cut:] for x in now]
        if cut:
            yield from work(*[x[:cut] for x in now])
        if len(held[0]) > POSTED:
            star = (held[0][0], held[1][0])
            yield out(np.full(len(held[1]), star[1]), held[1], True)
            held = [x[:0] for x in held]
    if len(held[0]):
        yield from work(*held)


def _once(edges: DataFrame) -> DataFrame:
    """Each edge once. An edge that any star needs is a star's: the suffix filter mustn't take a member out of its star."""
    return edges.groupBy("a", "b").agg(F.max("star").alias("star"))


def _suffixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = [batch.column(x).to_pylist() for x in ("a", "b", "n_a", "n_b", "sig_a", "sig_b")]
        ok = [may_link(sa, na, sb, nb) for na, nb, sa, sb in zip(*c[2:])]
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def link_sets(sets: list[np.ndarray], side: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; with side, only links between different sides count.

    Sets are taken by size. Candidates share a shingle of both prefixes (rare first, by counts among these sets) and pass the
    length filter and the suffix filter; the overlap of each is counted once, unless both are connected already.
    """
    m, up, forest = len(sets), list(range(len(sets))), []

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    if m == 2:
        a, b = sets
        if 100 * min(len(a), len(b)) >= PERCENT * max(len(a), len(b)) and len(np.intersect1d(a, b, assume_unique=True)) >= least_overlap(len(a), len(b)):
            forest.append((0, 1))
        return forest
    sizes = np.array([len(s) for s in sets])
    _, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    ids = [flat[e - n : e] for e, n in zip(ends, sizes)]
    shape = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64) for s in sets]).astype(np.int32)
    mark, posted = np.zeros(len(counts), dtype=bool), {}
    sides = np.array(side) if side is not None else None
    for x in np.argsort(sizes, kind="stable").tolist():
        n = int(sizes[x])
        own = ids[x]
        prefix = own[np.lexsort((own, counts[own]))[: prefix_length(n)]]
        prefix = prefix[counts[prefix] > 1]
        lists = [posted[t] for t in prefix.tolist() if t in posted]
        if lists:
            near = np.unique(np.concatenate([np.frombuffer(b, dtype=np.int32) for b in lists]))
            near = near[100 * sizes[near] >= PERCENT * n]
            if sides is not None:
                near = near[sides[near] != sides[x]]
            own_root = root(x)
            near = near[np.array([root(y) != own_root for y in near.tolist()], dtype=bool)] if len(near) else near
            if len(near):
                need = least_overlap(sizes[near], n)
                near = near[np.abs(shape[near] - shape[x]).sum(1) <= sizes[near] + n - 2 * need]
            if len(near):
                mark[own] = True
                common = np.add.reduceat(mark[np.concatenate([ids[y] for y in near.tolist()])], np.r_[0, np.cumsum(sizes[near])[:-1]], dtype=np.int64)
                mark[own] = False
                for y in near[common >= least_overlap(sizes[near], n)].tolist():
                    a, b = root(x), root(y)
                    if a != b:
                        up[a] = b
                        forest.append((x, y))
        one = np.int32(x).tobytes()
        for t in prefix.tolist():
            if t in posted:
                posted[t] += one
            else:
                posted[t] = bytearray(one)
    return forest


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (block, i, j, part, node, text) sorted by block, i, j."""
    key, nodes, sets, parts = None, [], [], []

    def done():
        if len(nodes) < 2:
            return None
        links = link_sets(sets, None if key[1] == key[2] else parts)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], names=["a", "b"]) if links else None

    for batch in batches:
        for *now, part, node, text in zip(*[batch.column(c).to_pylist() for c in ("block", "i", "j", "part", "node")], batch.column("text")):
            if now != key:
                if (found := done()) is not None:
                    yield found
                key, nodes, sets, parts = now, [], [], []
            nodes.append(node)
            sets.append(shingles(text.as_py()))
            parts.append(part)
    if (found := done()) is not None:
        yield found


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Null texts and texts without words have no shingles and link with nothing; their component_id is their doc_id. Equal
    sets link whatever their texts. Rows that share a doc_id are one document and share a component. A null doc_id is never
    a component_id: such a row shows its group's, or null. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    tables = written(texts.mapInArrow(tidied(_sets), "doc_id long, n long, hi long, lo long, sig binary, piece int, counts binary"), "jaccard-sets")
    rows = tables.where("piece is null").select("doc_id", "n", "hi", "lo", "sig")
    groups = rows.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("many"), F.first("sig").alias("sig"))
    groups = written(groups.where("node is not null"), "jaccard-groups")
    counts = spark.sparkContext.broadcast(sketch.total(tables.where("piece is not null").select("piece", "counts")))
    postings = texts.mapInArrow(tidied(_posted(counts)), "token long, lo long, n int, place int").repartition("token").sortWithinPartitions("token", "n", "lo")
    pairs = written(postings.mapInArrow(tidied(_paired), "a long, b long, star boolean").transform(_once), "jaccard-pairs")
    sigs = written(groups.select("lo", "n", "sig"), "jaccard-signatures")
    first, second = (sigs.select(F.col("lo").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    near = pairs.where("not star").select("a", "b").join(first, "a").join(second, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(tidied(_suffixed), "a long, b long")
    blocks = components(near.union(pairs.where("star").select("a", "b")), "jaccard-blocks")
    members = written(groups.select("lo", "node").join(blocks.withColumnRenamed("node", "lo").withColumnRenamed("component", "block"), "lo").select("node", "block"), "jaccard-members")
    sized = members.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    tiles = members.join(small(written(sized, "jaccard-large")), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "block", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    moved = texts.join(small(written(tiles, "jaccard-tiles")), F.col("doc_id") == F.col("node")).select("block", "i", "j", "part", "node", "text")
    moved = moved.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "node")
    found = components(moved.mapInArrow(tidied(_joined), "a long, b long"), "jaccard-links")
    found = written(found.select(F.col("node").alias("_node"), F.col("component").alias("_component")), "jaccard-components")
    copies = written(groups.where("many > 1").select("hi", "lo", "n", F.col("node").alias("_first")), "jaccard-copies")
    named = rows.select("doc_id", "n", "hi", "lo").join(small(copies), ["hi", "lo", "n"], "left").withColumn("_at", F.coalesce("_first", "doc_id"))
    return named.join(small(found), F.col("_at") == F.col("_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "_at").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each group the document with the smallest doc_id stays, of rows that share this id the one whose text comes first.

    Documents without shingles and rows with a null doc_id stay as they are.
    """
    found = written(linked(docs), "jaccard-found")
    gone = written(found.where("doc_id <> component_id and n_shingles > 0").select(F.col("doc_id").alias("_gone")).distinct(), "jaccard-gone")
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    left = packed.join(small(gone), F.col("_doc") == F.col("_gone"), "left_anti")
    again = written(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "jaccard-again")
    if again.limit(1).count():
        once = left.join(small(again), F.col("_doc") == F.col("_again"), "left_anti").select("_row")
        repeated = left.join(small(again), F.col("_doc") == F.col("_again"), "left_semi")
        left = once.union(repeated.groupBy("_doc").agg(F.min_by("_row", F.struct(F.col("_text").isNull(), "_text", F.to_json("_row"))).alias("_row")).select("_row"))
    return left.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
