"""Lookups in the object graph as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.storage import written


def dereference(objects: DataFrame) -> DataFrame:
    """doc_id, obj_num, ref_num, kind: what each object refers to; kind is null where the target is missing."""
    edges = objects.select("doc_id", "obj_num", F.explode("refs").alias("ref_num"))
    return edges.join(objects.select("doc_id", F.col("obj_num").alias("ref_num"), "kind"), ["doc_id", "ref_num"], "left").select("doc_id", "obj_num", "ref_num", "kind")


def page_index(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """targets (doc_id, obj_num, ...) with page, the first page of that object or null."""
    return targets.join(pages.groupBy("doc_id", "obj_num").agg(F.min("page").alias("page")), ["doc_id", "obj_num"], "left")


def named_destinations(names: DataFrame, destinations: DataFrame) -> DataFrame:
    """names (doc_id, name) with dest_page and to; null where the name or its page is unknown."""
    return names.join(destinations, ["doc_id", "name"], "left")


def latest(objects: DataFrame, order: str) -> DataFrame:
    """Of the definitions of (doc_id, obj_num) the last by order: an aggregate, so no window sorts a document's objects."""
    rest = [c for c in objects.columns if c not in ("doc_id", "obj_num")]
    return objects.groupBy("doc_id", "obj_num").agg(F.max_by(F.struct(*rest), order).alias("_l")).select("doc_id", "obj_num", *[F.col("_l").getField(c).alias(c) for c in rest])


def inherited(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """nodes (doc_id, node, parent, columns) with each column from the nearest ancestor that has one, at any depth.

    Pointers double: each round every node takes what its ancestor so far has gathered and asks that one's ancestor next, so a
    tree of depth d takes log2(d) rounds, each written once. As many rounds as the nodes of the largest document need in a
    row end cycles.
    """
    kept = [c for c in nodes.columns if c not in columns]
    out = written(nodes.withColumn("_above", F.col("parent")), "inherited")
    longest = out.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        if out.where("_above is not null").limit(1).count() == 0:
            break
        up = out.select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), F.col("_above").alias("_next"), *[F.col(c).alias(f"_up_{c}") for c in columns])
        joined = out.join(up, (F.col("doc_id") == F.col("_doc")) & (F.col("_above") == F.col("_node")), "left")
        out = written(joined.select(*kept, *[F.coalesce(c, f"_up_{c}").alias(c) for c in columns], F.col("_next").alias("_above")), "inherited")
    return out.select(*nodes.columns)


def image_files(images: DataFrame, image_data: DataFrame) -> DataFrame:
    """Each placed image with its file."""
    return images.join(image_data.select("doc_id", "xref", "ext", "image"), ["doc_id", "xref"], "left")


def overlapping(left: DataFrame, right: DataFrame, predicate, keys=("doc_id", "page"), boxes=None, size: float = 0.0) -> DataFrame:
    """keys and the other columns of both sides for pairs on the same page that meet the predicate: an equi join with a residual condition.

    predicate(l, r) makes the condition from functions that give a side's column by name. With boxes, the columns of the sides' rectangles, pairs
    whose rectangles have no point in common are left out: both sides meet in the squares of size that their rectangles touch, each
    pair in the square of its common corner alone, so a page of very many rectangles isn't one group.
    """
    a, b = (side.select(*keys, F.struct(*[c for c in side.columns if c not in keys]).alias(name)) for side, name in ((left, "_l"), (right, "_r")))
    on = list(keys)
    corner = F.lit(True)
    if boxes is not None:
        on += ["_sx", "_sy"]
        low = {k: F.greatest(F.col("_l")[boxes[0]][k], F.col("_r")[boxes[1]][k]) for k in ("x0", "y0")}
        corner = (F.floor(low["x0"] / size) == F.col("_sx")) & (F.floor(low["y0"] / size) == F.col("_sy"))
        for axis in "xy":
            a, b = (side.withColumn(f"_s{axis}", F.explode(F.sequence(F.floor(F.col(name)[box][f"{axis}0"] / size), F.floor(F.col(name)[box][f"{axis}1"] / size)))) for side, name, box in ((a, "_l", boxes[0]), (b, "_r", boxes[1])))
    found = a.join(b, on).where(corner).where(predicate(lambda c: F.col("_l").getField(c), lambda c: F.col("_r").getField(c)))
    return found.select(*keys, "_l.*", "_r.*")
