"""Secret scans: fixed patterns, then a battery of randomness tests on every token of a text (native).

A candidate is a run of 20 or more characters of the base64 alphabets in what the patterns' spans leave of the text. Its encoding is
inferred (hex, base32, base64), and its characters become numbers of that alphabet. Under uniform independent characters
three tests give near-normal deviates: chi-squared uniformity over the alphabet (by its cube root), runs about the
middle, and lag-one serial correlation. The sum of their squares is small for a random key of any length and grows with
the length of an ordinary word or identifier.

The null hypothesis is "ordinary": a noncentrality of NONCENTRALITY for each character. The p-value is the chance that an
ordinary string of that length looks so random, so short strings can hardly be discoveries. The false discovery rate is
held at LEVEL within each stratum of lengths (Benjamini-Hochberg), over all candidates of all documents, on p-values
rounded up to the edges of fixed bins, so that counts of bins are all that is gathered.

Scale: one scan of the texts writes spans and bins; the thresholds come from a partial aggregate of a few thousand bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.llm.common import let, written

#: Fixed values of the base rules, in the order in which kinds are listed.
PATTERNS = {
    "assign": "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
KINDS = [*PATTERNS, "random"]
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The hex pattern matches inside nearly every word; this one finds its passing matches alone, since matches are whole runs.
LONG_HEX, LONG_ACCESS = "[0-9a-f]{24,}", "AKIA[A-Z0-9]{16,}"
#: What stands for a character of a base span, spans that are put together at a time, and their type.
OVER, BLOCK, SPANS = "\x01", 256, "array<struct<start:int,kind:int,end:int,n:int>>"

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}+"
#: The alphabets by inferred encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
NONCENTRALITY, LEVEL = 1.0, 0.01
#: Lengths at which a new stratum begins, bins per factor of ten of p, and the last bin.
STRATA, PER_TEN, LAST_BIN = (20, 32, 48, 96, 256), 20, 300


def _found(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """struct(start, kind, end, n) of each match, in order; n is the length of the group."""

    def fold(parts):
        # Spans are put together BLOCK at a time, since an array is copied with each item that it takes.
        def block(first):
            last = F.least(first + BLOCK, F.size(parts["hits"])) - 1

            def step(acc, k):
                def item(start):
                    end = start + F.length(F.get(parts["hits"], k))
                    span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), F.length(F.get(parts["groups"], k)).alias("n"))
                    return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

                return let(acc["at"] + F.length(F.get(parts["rest"], k)), item)

            return lambda at: F.aggregate(F.sequence(first, last), F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step)

        def blocks(acc, first):
            return let(block(first)(acc["at"]), lambda b: F.struct(b["at"].alias("at"), F.array_append(acc["out"], b["out"]).alias("out")))

        starts = F.sequence(F.lit(0), F.size(parts["hits"]) - 1, F.lit(BLOCK))
        return F.flatten(F.aggregate(starts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), blocks)["out"])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(hits.alias("hits"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits).alias("groups"), F.split(text, pattern, -1).alias("rest"))
    return F.when(text.rlike(pattern), let(parts, fold)).otherwise(F.array().cast(SPANS))


def _cut(text: Column, pattern: str, passes=None) -> Column:
    """text with each match that passes written over by as many characters that no candidate has."""

    def written_over(parts):
        def piece(rest, k):
            hit = F.get(parts["hits"], k)
            over = F.repeat(F.lit(OVER), F.length(hit))
            return F.concat(rest, F.coalesce(over if passes is None else F.when(passes(F.get(parts["groups"], k)), over).otherwise(hit), F.lit("")))

        return F.array_join(F.transform(parts["rest"], piece), "")

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(hits.alias("hits"), (hits if passes is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).alias("groups"), F.split(text, pattern, -1).alias("rest"))
    return F.when(text.rlike(pattern), let(parts, written_over)).otherwise(text)


def without_base(text: Column) -> Column:
    """text with what the base rules find written over, kind by kind: passing assignments, then keys and hex runs of what is left."""
    out = _cut(text, PATTERNS["assign"], lambda group: F.length(group) >= LEAST["assign"])
    return _cut(_cut(out, LONG_ACCESS), LONG_HEX)


def base_spans(text: Column) -> Column:
    """The passing matches of the base rules by start, then kind."""
    each = [F.filter(_found(text, PATTERNS["assign"], "assign", 2), lambda x: x["n"] >= LEAST["assign"]), F.filter(_found(text, PATTERNS["access"], "access"), lambda x: x["n"] >= LEAST["access"]), _found(text, LONG_HEX, "hex")]
    return F.sort_array(F.concat(*each))


def _normal(z: Column) -> Column:
    """The standard normal distribution function, to 1e-7 of its tail: a continued fraction beyond 2, a series within."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    deep = F.lit(0.0)
    for k in range(12, 0, -1):
        deep = F.lit(float(k)) / (x + deep)
    t = 1 / (1 + 0.2316419 * x)  # fixed values: a published rational approximation
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.when(x > 2, density / (x + deep)).otherwise(near)
    return F.when(z < 0, tail).otherwise(1 - tail)


def _deviates(idx: Column, size: Column) -> Column:
    """The sum of squares of the three deviates of idx (numbers below size)."""
    n = F.size(idx).cast("double")
    zero = F.lit(0).cast("long")

    def count(k):
        return F.size(F.filter(idx, lambda x: x == k)).cast("long")

    squares = F.aggregate(F.sequence(F.lit(0), size - 1), zero, lambda acc, k: acc + let(count(k), lambda c: c * c))
    df = (size - 1).cast("double")
    chi = squares.cast("double") * size / n - n
    uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    after = F.slice(idx, 2, F.size(idx) - 1)
    high = F.size(F.filter(idx, lambda x: 2 * x >= size)).cast("double")
    runs = 1 + F.aggregate(F.zip_with(F.slice(idx, 1, F.size(idx) - 1), after, lambda a, b: ((2 * a >= size) != (2 * b >= size)).cast("long")), zero, lambda acc, x: acc + x)
    mean = 1 + 2 * high * (n - high) / n
    runs_z = F.when((high > 0) & (high < n), (runs - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))).otherwise(F.sqrt(n))
    total = F.aggregate(idx, zero, lambda acc, x: acc + x).cast("double")
    square = F.aggregate(idx, zero, lambda acc, x: acc + x * x).cast("double")
    cross = F.aggregate(F.zip_with(F.slice(idx, 1, F.size(idx) - 1), after, lambda a, b: (a * b).cast("long")), zero, lambda acc, x: acc + x).cast("double")
    center = total / n
    spread = square - n * center * center
    ends = F.get(idx, F.lit(0)) + F.get(idx, F.size(idx) - 1)
    lagged = cross - center * (2 * total - ends) + (n - 1) * center * center
    serial = F.when(spread > 0, lagged / spread * F.sqrt(n)).otherwise(F.sqrt(n))
    up = F.greatest(uniform, F.lit(0.0))
    return up * up + runs_z * runs_z + serial * serial


def p_value(token: Column) -> Column:
    """The chance that an ordinary string of the token's length looks so random; null for digits alone, which are no encoding of keys."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")

    def tested(s):
        kind = F.when(s.rlike("^[0-9]*$"), None).when(s.rlike("^[0-9a-f]*$"), ALPHABETS["hex"]).when(s.rlike("^[0-9A-F]*$"), ALPHABETS["HEX"]).when(s.rlike("^[A-Z2-7]*$"), ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        return F.when(F.length(s) >= STRATA[0] - 2, let(F.struct(s.alias("s"), kind.alias("a")), chance))

    def chance(x):
        idx = F.filter(F.transform(F.split(x["s"], ""), lambda c: F.position(c, x["a"]) - 1), lambda k: k >= 0)
        return F.when(x["a"].isNotNull(), let(idx, lambda i: let(F.struct(_deviates(i, F.length(x["a"])).alias("d"), (F.size(i) * NONCENTRALITY).alias("l")), lambda y: far(y["d"], y["l"]))))

    def far(d, shift):
        k = 3.0
        f, c = (k + shift) * (k + shift) / (k + 2 * shift), (k + 2 * shift) / (k + shift)
        return _normal((F.pow(d / (c * f), F.lit(1 / 3)) - (1 - 2 / (9 * f))) / F.sqrt(2 / (9 * f)))

    return let(bare, tested)


def _stratum(n: Column) -> Column:
    out = F.lit(0)
    for k, start in enumerate(STRATA[1:], 1):
        out = F.when(n >= start, k).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """struct(start, end, stratum, bin) of each testable token of what the base rules leave of text; bin rises as p falls."""

    def tested(r):
        p = p_value(F.substring(text, r["start"] + 1, r["n"]))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), _stratum(r["n"]).alias("stratum"), F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * PER_TEN).cast("int")).alias("bin"))

    runs = F.when(text.rlike(CANDIDATE), _found(without_base(text), CANDIDATE, "random")).otherwise(F.array().cast(SPANS))
    return F.filter(F.transform(runs, tested), lambda x: x["bin"].isNotNull())


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base and found of every row of docs (doc_id, text): base spans and tested candidates."""
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    return bare.withColumn("found", candidates(F.col("text"))).select("doc_id", "base", "found")


def thresholds(found: DataFrame, level: float = LEVEL) -> DataFrame:
    """One row: cuts, for each stratum the least bin that is a discovery. A bin's p-value counts as its upper edge."""
    bins = found.select(F.explode("found").alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias("n"))
    down = W.partitionBy("stratum").orderBy(F.col("bin").desc())
    whole = W.partitionBy("stratum")
    held = bins.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(whole)).where(F.pow(F.lit(10.0), -F.col("bin") / PER_TEN) <= level * F.col("upto") / F.col("all"))
    cuts = held.groupBy("stratum").agg(F.min("bin").alias("cut"))
    listed = cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("m"))
    return listed.select(F.transform(F.sequence(F.lit(0), F.lit(len(STRATA) - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(LAST_BIN + 1))).alias("cuts"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_random, spans for every row of docs (doc_id, text).

    Null texts count as empty and have no spans; their base_sha256 is that of the empty string. Spans count code points,
    the end not included. Rows are scanned one by one, so repeated rows and null ids need no rule, though all candidates
    share in the false discovery rate. An empty table gives an empty result. Other columns are not looked at.
    """
    have = written(scanned(docs), "secrets-scanned")
    cuts = written(thresholds(have, level), "secrets-cuts").select("cuts").scalar()
    marked = have.withColumn("_cuts", cuts).withColumn("found", F.filter("found", lambda x: x["bin"] >= F.get(F.col("_cuts"), x["stratum"])))
    extra = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end"), (x["end"] - x["start"]).alias("n")))

    def many(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return marked.select("doc_id", *[many(k) for k in PATTERNS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), F.size("found").cast("long").alias("n_random"), _joined(F.sort_array(F.concat("base", extra))).alias("spans"))
