"""Glyphs to lines, words, blocks, spans and text, in Catalyst.

Lines need a fold, since a line is anchored at its first glyph: one array per page, in one shuffle on (doc_id, page).
Everything after it partitions by the same keys or finer ones, so the plan has no further exchange. Pages are small; a
giant document is many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions.text import is_blank, needs_space

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "block", "line"]
BLANK = "\0\t\n\x0b\x0c\r "


def _bbox() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def line_numbers(glyphs: DataFrame) -> DataFrame:
    """glyphs with line_no, the number of its line on the page.

    Glyphs go by baseline, to a tenth, and place. A new line begins where the baseline is further from that of the line's first
    glyph than half a size and three points.
    """
    rest = [c for c in glyphs.columns if c not in (*PAGE, "ox", "seq")]
    item = F.struct(F.round("oy", 1).alias("_k"), "ox", "seq", *rest)
    folded = glyphs.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("g"))
    # The fold writes only where a line starts, so its cost is that of the glyphs; lines are slices between the starts.
    start = F.struct(F.lit(None).cast("double").alias("base"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, g):
        new = acc["base"].isNull() | (F.abs(g["oy"] - acc["base"]) > F.greatest(0.5 * g["size"], F.lit(3.0)))
        return F.struct(F.when(new, g["oy"]).otherwise(acc["base"]).alias("base"), (acc["at"] + 1).alias("at"), F.when(new, F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out"))

    starts = folded.withColumn("s", F.aggregate("g", start, step, lambda acc: acc["out"]))
    lines = F.transform("s", lambda x, k: F.struct(k.alias("line_no"), F.slice("g", x + 1, F.coalesce(F.get("s", k + 1), F.size("g")) - x).alias("g")))
    sliced = starts.select(*PAGE, F.inline(lines))
    return sliced.select(*PAGE, "line_no", F.explode("g").alias("x")).select(*[c if c in PAGE else F.col("x").getField(c).alias(c) for c in glyphs.columns], "line_no")


def structured(glyphs: DataFrame) -> DataFrame:
    """glyphs with block, line (from 0 in its block), before_x1, before_size and before_text of the glyph before it on the line.

    A block begins where the gap to the line before is more than 0.8 of the line's height. All windows keep to the pages that the
    fold has put together.
    """
    own, along = W.partitionBy(*PAGE, "line_no"), W.partitionBy(*PAGE, "line_no").orderBy("ox", "seq")
    down = W.partitionBy(*PAGE).orderBy("line_no", "ox", "seq")
    s = line_numbers(glyphs).select("*", F.min("y0").over(own).alias("_top"), F.max("y1").over(own).alias("_bottom"), F.max(F.col("y1") - F.col("y0")).over(own).alias("_high"), F.row_number().over(along).alias("_at"))
    gap = (F.col("_at") == 1) & (F.col("_top") - F.lag("_bottom").over(down) > 0.8 * F.col("_high"))
    s = s.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("block", F.sum("_gap").over(down).cast("int"))
    s = s.withColumn("line", (F.col("line_no") - F.min("line_no").over(W.partitionBy(*PAGE, "block"))).cast("int"))
    s = s.select("*", F.lag("x1").over(along).alias("before_x1"), F.lag("size").over(along).alias("before_size"), F.lag("text").over(along).alias("before_text"))
    return s.drop("_top", "_bottom", "_high", "_at", "_gap")


def words(glyphs: DataFrame, corpus=None) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1, word, block, line, word_no. A blank glyph ends a word, and so does a gap of a quarter size."""
    s = structured(glyphs).withColumn("blank", is_blank(F.col("text")))
    along = W.partitionBy(*LINE).orderBy("ox", "seq")
    starts = F.lag("blank", 1, True).over(along) | needs_space(F.col("before_x1"), F.col("before_size"), F.col("x0"))
    s = s.withColumn("word_no", F.sum((~F.col("blank") & starts).cast("int")).over(along) - 1).where(~F.col("blank"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ox", "seq", "text"))), lambda x: x["text"]), "")
    return s.groupBy(*LINE, "word_no").agg(*_bbox(), text.alias("word")).select(*PAGE, "x0", "y0", "x1", "y1", "word", "block", "line", F.col("word_no").cast("int").alias("word_no"))


def _line_text() -> Column:
    """Glyph texts in order; a gap adds a blank unless one is there. The fold looks at what is written so far, since a glyph's text may be empty."""
    items = F.sort_array(F.collect_list(F.struct("ox", "seq", "text", needs_space(F.col("before_x1"), F.col("before_size"), F.col("x0")).alias("gap"))))
    joined = F.aggregate(items, F.lit(""), lambda acc, g: F.concat(acc, F.when(g["gap"] & (g["text"] != " ") & ~acc.endswith(" "), " ").otherwise(""), g["text"]))
    return F.rtrim(joined, F.lit(BLANK))


def lines(glyphs: DataFrame, corpus=None) -> DataFrame:
    return structured(glyphs).groupBy(*LINE).agg(*_bbox(), _line_text().alias("text")).select(*LINE, "x0", "y0", "x1", "y1", "text")


def blocks(glyphs: DataFrame, corpus=None) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1, text, block, type (always 0)."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines(glyphs).groupBy(*PAGE, "block").agg(*_bbox(), text.alias("text")).select(*PAGE, "x0", "y0", "x1", "y1", "text", "block", F.lit(0).alias("type"))


def text(glyphs: DataFrame, corpus=None) -> DataFrame:
    """doc_id, page, text: lines by line ends, blocks by empty lines, without blanks at the ends. With the corpus, pages without glyphs have an empty text."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n")
    clean = F.trim(F.regexp_replace(whole, "[ \\t]+\\n", "\n"), F.lit(BLANK))
    found = blocks(glyphs).groupBy(*PAGE).agg(clean.alias("text"))
    return found if corpus is None else corpus.pages.select(*PAGE).join(found, PAGE, "left").withColumn("text", F.coalesce("text", F.lit("")))


def spans(glyphs: DataFrame, corpus=None) -> DataFrame:
    """doc_id, page, block, line, span, text, font, size and box of each run of glyphs of one size."""
    along = W.partitionBy(*LINE).orderBy("ox", "seq")
    s = structured(glyphs).withColumn("span", F.sum((F.col("size") != F.coalesce("before_size", "size")).cast("int")).over(along).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ox", "seq", "text"))), lambda x: x["text"]), "")
    return s.groupBy(*LINE, "span").agg(joined.alias("text"), F.first("font").alias("font"), F.first("size").alias("size"), *_bbox()).select(*LINE, "span", "text", "font", "size", "x0", "y0", "x1", "y1")


def page_dict(glyphs: DataFrame, corpus=None) -> DataFrame:
    """doc_id, page and blocks, nested to lines and spans; with the corpus also the width and height of the page's media box."""
    box = F.struct("x0", "y0", "x1", "y1").alias("bbox")

    def collected(*fields, key):
        return F.sort_array(F.collect_list(F.struct(key, *fields)))

    by_line = spans(glyphs).groupBy(*LINE).agg(collected("text", "font", "size", box, key="span").alias("spans"), *_bbox())
    by_block = by_line.groupBy(*PAGE, "block").agg(collected(box, "spans", key="line").alias("lines"), *_bbox())
    shown = by_block.select(*PAGE, "block", F.struct(F.lit(0).alias("type"), F.col("block").alias("number"), box, "lines").alias("b"))
    out = shown.groupBy(*PAGE).agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "b"))), lambda x: x["b"]).alias("blocks"))
    return out if corpus is None else corpus.pages.select(*PAGE, (F.col("mediabox.x1") - F.col("mediabox.x0")).alias("width"), (F.col("mediabox.y1") - F.col("mediabox.y0")).alias("height")).join(out, PAGE, "left")


TABLES = {"words": words, "lines": lines, "blocks": blocks, "spans": spans, "text": text, "page_dict": page_dict}


def get_text(corpus, mode: str = "text") -> DataFrame:
    """One table by the name of a text mode; rawdict is the same as dict."""
    names = {"text": "text", "words": "words", "blocks": "blocks", "dict": "page_dict", "rawdict": "page_dict"}
    if mode not in names:
        raise ValueError(f"unknown text mode: {mode}")
    return getattr(corpus, names[mode])
