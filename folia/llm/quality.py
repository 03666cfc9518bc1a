"""Quality rules: fixed rules on each text, then a hashed n-gram log-likelihood ratio (native).

Unigrams and bigrams of a text's words, hashed into a fixed number of buckets, are counted over the trusted documents
and over all documents. A document's score is the mean over its n-grams of log p_trusted - log p_raw; it stays if the score reaches
a fixed threshold. The trusted counts are smoothed by the raw distribution, so few trusted documents pull scores to 0. Counts are whole numbers and a document's terms are summed
in order, so verdicts never depend on how rows are dealt out.

Scale: two scans of the documents and no shuffle of them. The counts are partial aggregates of one row per bucket and
task; the ratios are one row of n_buckets doubles. Everything else happens within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import BLANKS, column, let, words, written

#: Buckets of hashed n-grams, and the n-grams of the raw distribution that are added to the trusted ones.
BUCKETS, SMOOTHING = 1 << 14, float(1 << 14)
#: The least score a document needs: 0 is as likely trusted as raw; one nat in ten n-grams less still passes.
THRESHOLD = -0.1
#: At most so many trusted documents make up the target; those with the least hash of their id are taken.
MAX_TRUSTED = 50_000
#: Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5


def _features(w: Column, buckets: int) -> Column:
    """The buckets of a word array's unigrams and bigrams; the last bigram ends with the text."""
    one = F.transform(w, lambda a: F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int"))
    two = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def _windows(w: Column) -> Column:
    """A 64-bit hash for each window of five words."""
    n = F.size(w) - (WINDOW - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(-1, WINDOW - 1)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more: repeated windows by place, each adding what the next leaves uncovered."""

    def places(s):
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (F.get(s, k)["h"] == F.coalesce(F.get(s, k - 1)["h"], F.get(s, k)["h"] - 1)) | (F.get(s, k)["h"] == F.coalesce(F.get(s, k + 1)["h"], F.get(s, k)["h"] - 1)))
        return F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"]))

    def total(p):
        step = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    heavy = let(let(pairs, places), total)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(heavy)


def verdict(text: Column, llr: Column, threshold: float, buckets: int) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of a text.

    One expression in which every array is bound once, so that no filter pushed below a projection repeats it.
    """
    bare = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(bare, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")

    def figures(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(bare, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(_windows(w), _covered).alias("n_repeat_words"),
            F.aggregate(_features(w, buckets), F.lit(0.0), lambda acc, b: acc + F.get(llr, b)).alias("total"),
        )

    def judged(x):
        failed = (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > REPEATED_PERCENT * x["n_words"])
        score = F.when(x["n_words"] > 0, x["total"] / (2.0 * x["n_words"]))
        own = [x[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*own, failed.alias("base_failed"), score.alias("score"), (~failed & F.coalesce(score >= threshold, F.lit(False))).alias("kept"))

    return let(let(words(text), figures), judged)


def trusted(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """doc_id of the trusted documents: labelled of good quality; with more than most of them, those of least hash."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: llr, an array with log p_target - log p_raw of each bucket."""
    known = target.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_in"))
    marked = docs.select("doc_id", let(words(F.col("text")), lambda w: _features(w, buckets)).alias("f")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left")
    counts = marked.select("_in", F.explode("f").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_in").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b"))
    whole = every.join(counts, F.col("_b") == F.col("bucket"), "left").select("_b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    totals = whole.agg(F.sort_array(F.collect_list(F.struct("_b", "raw", "good"))).alias("each"), F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    ratio = F.transform("each", lambda x: F.when(x["raw"] == 0, 0.0).otherwise(F.log((x["good"] * (F.col("raws") / x["raw"]) + smoothing) / (F.col("goods") + smoothing))))
    return totals.select(ratio.alias("llr"))


def assessed(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """_row (the row of docs), doc_id, n_words, the base figures, base_failed, score and kept for every row of docs (doc_id, text).

    Null and blank texts have no words, fail the base rules and have a null score. Rows are judged one by one, so
    repeated rows get the same verdict. Null ids are never trusted. Without trusted documents every bucket has the same
    ratio, 0, and the base rules decide alone. An empty table gives an empty result.
    """
    llr = written(ratios(docs, trusted(labels, max_trusted), buckets), "quality-ratios")
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), "doc_id", "text").withColumn("_llr", llr.select("llr").scalar())
    return packed.withColumn("_v", verdict(F.col("text"), F.col("_llr"), threshold, buckets)).select("_row", "doc_id", "_v.*")


def verdicts(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    return assessed(docs, labels, **settings).drop("_row")


def kept(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs that pass, with docs' own columns."""
    return assessed(docs, labels, **settings).where("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
