"""Mixing sources to target weights by Pareto order sampling (native).

Every document has an expected number of copies e = min(max_copies, c * w): w is its draw weight and c its source's
scale, solved so that the expected words of a source equal its target. floor(e) copies are certain. The rest,
p = e - floor(e), is an inclusion probability: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a keyed
uniform number of the document, and the first ones are taken until the source's remaining words are used up.
One further document, the one whose size fits best, closes the gap that whole documents leave.

Sizes and draw weights are integers, so sums are exact and reruns agree whatever the order of rows.

Scale: the documents are never shuffled. Sums per (source, draw weight) come from map-side partial aggregation;
the cut of a source is found on sums over about sqrt(n) bins of the rank and then inside one bin of about
sqrt(n) rows (near the cut, the rank's density is at most 1, so no bin there is crowded).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.llm.common import column, n_words, small, written

SEED = "folia-mix-1"
#: Fixed values of the query's contract: weights of sources by rank, repeating, and the most a document may be repeated.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


@dataclass(frozen=True)
class Plan:
    """sources (source, source_size, target) and scales (source, draw, e), cuts (source, bins, at_bin, cut_v, cut_id, fill_v, fill_id)."""

    sources: DataFrame
    scales: DataFrame
    cuts: DataFrame


def draw_weight(size: Column) -> Column:
    """The bit length of the size: longer documents are likelier, by steps of one for each doubling."""
    return F.length(F.bin(size)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A keyed uniform number in (0, 1): 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size) with target: 100 % of all words by weight, capped at max_copies times each source.

    Sources rank by code point, null last. The capped shares are a water level: sources sorted by cap over weight,
    the first at which the level fits below its cap fixes it. One row per source is the only thing on one task here.
    """
    order = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(order, ((F.col("at") - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    by = W.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col("at"))
    before, after, every = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing), W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(after)
    return (
        ranked.withColumn("level", level)
        .withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap").cast("double"), F.col("level")))
        .withColumn("level", F.first("fits", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))).alias("target"))
    )


def _scales(classes: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """e for each (source, draw), the draws capped from the largest down until the scale fits."""
    joined = classes.join(small(sources), classes["source"].eqNullSafe(sources["source"])).select(classes["source"], "draw", "n", "words", "target")
    by = W.partitionBy("source").orderBy(F.col("draw").desc())
    before, after, whole = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scale = (F.col("target") - (F.coalesce(F.sum("words").over(before), F.lit(0)) * max_copies).cast("double")) / F.sum(F.col("draw") * F.col("words")).over(after).cast("double")
    return (
        joined.where("words > 0")
        .withColumn("scale", scale)
        .withColumn("fits", F.when(F.col("scale") * F.col("draw") <= max_copies, F.col("scale")))
        .withColumn("scale", F.coalesce(F.first("fits", ignorenulls=True).over(whole), F.last("scale").over(whole)))
        .withColumn("e", F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), F.col("scale") * F.col("draw"))))
        .select("source", "draw", "n", "words", "target", "e")
    )


def _ranked(slim: DataFrame, scales: DataFrame, seed: str) -> DataFrame:
    """slim (doc_id, source, size) with copies, p and v in [0, 1], which rises with the Pareto rank; v is null if p is 0."""
    s = scales.select(F.col("source").alias("_s"), F.col("draw").alias("_d"), "e")
    u = uniform(F.col("doc_id"), seed)
    out = slim.withColumn("draw", draw_weight(F.col("size"))).join(small(s), F.col("source").eqNullSafe(F.col("_s")) & (F.col("draw") == F.col("_d")), "left").drop("_s", "_d")
    out = out.withColumn("copies", F.coalesce(F.floor("e"), F.lit(0)).cast("long")).withColumn("p", F.coalesce(F.col("e") - F.col("copies"), F.lit(0.0))).withColumn("u", u)
    odds = F.col("u") * (1 - F.col("p"))
    return out.withColumn("v", F.when(F.col("p") > 0, odds / (odds + (1 - F.col("u")) * F.col("p"))))


def plan(slim: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> Plan:
    """The decisions over slim (doc_id, source, size), as three small tables."""
    classes = written(slim.groupBy("source", draw_weight(F.col("size")).alias("draw")).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-classes")
    sources = written(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies), "mix-sources")
    scales = written(_scales(classes, sources, max_copies), "mix-scales")
    rest = scales.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.floor("e") * F.col("words")).alias("sure"), F.sum("n").alias("n"))
    rest = written(rest.select("source", (F.col("target") - F.col("sure").cast("double")).alias("left"), (F.floor(F.sqrt(F.col("n").cast("double"))) + 1).alias("bins")), "mix-rest")
    ranked = written(_ranked(slim, scales, seed).where("p > 0").select("doc_id", "source", "size", "v"), "mix-ranked")
    r = rest.select(F.col("source").alias("_s"), "left", "bins")
    binned = ranked.join(small(r), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("bin", F.floor(F.col("v") * F.col("bins")))
    sums = binned.groupBy("source", "bin", "left", "bins").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    edge = sums.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left"))).groupBy("source").agg(F.min("bin").alias("at_bin"), F.min_by("before", "bin").alias("before"))
    edge = written(edge, "mix-edge")
    e = edge.select(F.col("source").alias("_e"), "at_bin", "before")
    inside = binned.join(small(e), F.col("source").eqNullSafe(F.col("_e")) & (F.col("bin") == F.col("at_bin"))).drop("_e")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("v", F.col("doc_id").asc_nulls_first())))
    last = inside.where("upto <= left").groupBy("source").agg(F.max(F.struct("v", "doc_id")).alias("cut"), F.max("upto").alias("upto"))
    l_ = last.select(F.col("source").alias("_l"), "cut", "upto")
    cuts = edge.join(l_, F.col("source").eqNullSafe(F.col("_l")), "left").drop("_l").join(r, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cuts = written(cuts.select("source", "bins", "at_bin", F.col("cut.v").alias("cut_v"), F.col("cut.doc_id").alias("cut_id"), (F.col("left") - F.coalesce("upto", "before")).alias("gap")), "mix-cuts")
    c = cuts.withColumnRenamed("source", "_s")
    over = binned.drop("bins").join(small(c), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").where(~_below(F.col("v"), F.col("doc_id"))).where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    fill = over.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "v", "doc_id")).alias("fill"))
    f = fill.select(F.col("source").alias("_f"), F.col("fill.v").alias("fill_v"), F.col("fill.doc_id").alias("fill_id"))
    return Plan(sources, scales, written(cuts.join(f, F.col("source").eqNullSafe(F.col("_f")), "left").drop("_f", "gap"), "mix-plan"))


def _below(v: Column, doc_id: Column) -> Column:
    """Whether a document ranks before or at the cut of its source."""
    at = F.floor(v * F.col("bins"))
    inside = (v < F.col("cut_v")) | ((v == F.col("cut_v")) & (F.coalesce(doc_id < F.col("cut_id"), doc_id.isNull()) | doc_id.eqNullSafe(F.col("cut_id"))))
    return F.coalesce((at < F.col("at_bin")) | ((at == F.col("at_bin")) & F.col("cut_v").isNotNull() & inside), F.lit(False))


def decide(slim: DataFrame, made: Plan, seed: str = SEED) -> DataFrame:
    """slim (doc_id, source, size, ...) with source_size, target, copies and taken. A source without a cut takes all it may."""
    c = made.cuts.withColumnRenamed("source", "_s")
    t = made.sources.select(F.col("source").alias("_t"), "source_size", "target")
    out = _ranked(slim, made.scales, seed).join(small(c), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").join(small(t), F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    v, doc_id = F.col("v"), F.col("doc_id")
    fill = F.coalesce((v == F.col("fill_v")) & doc_id.eqNullSafe(F.col("fill_id")), F.lit(False))
    drawn = v.isNotNull() & (F.col("at_bin").isNull() | _below(v, doc_id) | fill)
    return out.withColumn("copies", F.col("copies") + drawn.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    Null and blank texts have size 0 and take 0 words. A null source is a source of its own, ranked last. Null ids share
    one random number; rows that repeat an id and a text are drawn together. An empty table gives an empty result.
    """
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return decide(slim, plan(slim, weights, max_copies, seed), seed).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' own columns. The texts are not shuffled."""
    sized = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"))
    made = plan(written(sized.select("doc_id", "source", "size"), "mix-sizes"), weights, max_copies, seed)
    taken = decide(sized, made, seed).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
