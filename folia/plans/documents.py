"""Queries over PDF corpora: made from whole tables, written as PDF, read back and compared with SQL over the rows they came from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia import render
from folia.functions import text as T
from folia.operators import authoring, grouping, navigation
from folia.pdf.fonts import COURIER, HELVETICA, HELVETICA_BOLD
from folia.pdf.images import Pixmap, unpng
from folia.plans import corpora
from folia.plans.geometry import k, sql_k
from folia.sources import tables
from folia.sources.tables import Corpus


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nations(spark, sf_dir) -> DataFrame:
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("doc_id"), F.col("n_nationkey").cast("int").alias("pos"), F.col("n_name").alias("name"), F.col("r_name").alias("title"))


def _sheet(df: DataFrame, per_page: int = 40) -> DataFrame:
    """df (doc_id, n from 0, text): commands with one line per row, 18 points apart."""
    at = F.col("n") % per_page
    return df.select("doc_id", (F.col("n") / per_page).cast("int").alias("page"), at.cast("int").alias("seq"), F.lit(50.0).alias("x0"), (60.0 + at * 18).alias("y0"), F.col("text"), F.lit("helv").alias("fontname"), F.lit(10.0).alias("fontsize"))


def _customers(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    c = _t(spark, sf_dir, "customer")
    n = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return c.select(F.col("c_nationkey").cast("string").alias("doc_id"), n.alias("n"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))


CUSTOMERS = "rows_ AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, c_name || ' ' || c_mktsegment AS text FROM customer)"
_WIDTHS = "[" + ", ".join(map(str, HELVETICA)) + "]"
_BOLD = "[" + ", ".join(map(str, HELVETICA_BOLD)) + "]"


def _units(text: str, table: str = _WIDTHS) -> str:
    return f"coalesce(list_sum(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN ascii(c) BETWEEN 32 AND 126 THEN {table}[ascii(c) - 31] ELSE 556 END)), 0)"


def _read(df: DataFrame, **sizes) -> Corpus:
    return Corpus(authoring.write_documents(_sheet(df), **sizes))


def flagship_roundtrip(spark, sf_dir):
    """A PDF per region with a line per nation, written, read back, and counted by word."""
    words = _read(_nations(spark, sf_dir).select("doc_id", F.col("pos").alias("n"), F.col("name").alias("text"))).words
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.countDistinct("word").alias("n_distinct"), F.sum(F.length("word")).alias("n_chars"))


FLAGSHIP = """
WITH w AS (SELECT r_name AS doc_id, unnest(string_split(n_name, ' ')) AS word FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM w GROUP BY 1
"""


def roundtrip_text(spark, sf_dir):
    return _read(_customers(spark, sf_dir)).text.select("doc_id", "page", F.md5(F.regexp_replace("text", "\n+", "\n").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n"))


ROUNDTRIP_TEXT = f"""
WITH {CUSTOMERS}, p AS (SELECT doc_id, CAST(n // 40 AS INT) AS page, string_agg(text, chr(10) ORDER BY n) AS t FROM rows_ GROUP BY ALL)
SELECT doc_id, page, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM p
"""


def roundtrip_words(spark, sf_dir):
    w = _read(_customers(spark, sf_dir)).words
    return w.select("doc_id", "page", "line", "block", "word_no", "word", *[k(F.col(c) + 1e-6, 100).alias(c) for c in ("x0", "y0", "x1", "y1")])


ROUNDTRIP_WORDS = f"""
WITH {CUSTOMERS}, w AS (SELECT doc_id, CAST(n // 40 AS INT) AS page, CAST(n % 40 AS INT) AS line, 0 AS block, string_split(text, ' ') AS ws FROM rows_),
e AS (SELECT doc_id, page, line, block, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS word_no, unnest(ws) AS word, ws FROM w),
p AS (SELECT *, 50 + {_units("array_to_string(ws[1:word_no], ' ') || CASE WHEN word_no > 0 THEN ' ' ELSE '' END")} / 100.0::DOUBLE AS a, {_units("word")} / 100.0::DOUBLE AS b FROM e)
SELECT doc_id, page, line, block, word_no, word, {sql_k("a + 1e-6", 100)} AS x0, {sql_k("60 + line * 18 - 8 + 1e-6", 100)} AS y0, {sql_k("a + b + 1e-6", 100)} AS x1, {sql_k("60 + line * 18 + 2 + 1e-6", 100)} AS y1 FROM p
"""


def roundtrip_blocks(spark, sf_dir):
    """Every fifth line is left out, so that the gap begins a block."""
    rows = _customers(spark, sf_dir).withColumn("n", F.col("n") + F.floor(F.col("n") / 4))
    return _read(rows).blocks.select("doc_id", "page", "block", "type", F.md5(F.col("text").cast("binary")).alias("digest"), k(F.col("y0") + 1e-6, 100).alias("y0"), k(F.col("y1") + 1e-6, 100).alias("y1"))


ROUNDTRIP_BLOCKS = f"""
WITH {CUSTOMERS}, g AS (SELECT doc_id, n + n // 4 AS n, text FROM rows_), p AS (SELECT doc_id, CAST(n // 40 AS INT) AS page, n % 40 AS line, text FROM g)
SELECT doc_id, page, CAST(line // 5 AS INT) AS block, 0 AS type, md5(string_agg(text, chr(10) ORDER BY line)) AS digest, {sql_k("60 + min(line) * 18 - 8 + 1e-6", 100)} AS y0, {sql_k("60 + max(line) * 18 + 2 + 1e-6", 100)} AS y1 FROM p GROUP BY ALL
"""


def roundtrip_spans(spark, sf_dir):
    """The second word of each line is larger and stands on the same baseline."""
    sheet = _sheet(_customers(spark, sf_dir))
    first = sheet.withColumn("text", F.split_part("text", F.lit(" "), F.lit(1)))
    second = sheet.withColumn("text", F.split_part("text", F.lit(" "), F.lit(2))).withColumn("x0", F.lit(300.0)).withColumn("fontsize", F.lit(12.0)).withColumn("seq", F.col("seq") + 100)
    spans = Corpus(authoring.write_documents(first.unionByName(second))).spans
    return spans.select("doc_id", "page", "line", "span", "text", "font", F.col("size").cast("int").alias("size"))


ROUNDTRIP_SPANS = f"""
WITH {CUSTOMERS}, w AS (SELECT doc_id, CAST(n // 40 AS INT) AS page, CAST(n % 40 AS INT) AS line, string_split(text, ' ') AS ws FROM rows_)
SELECT doc_id, page, line, CAST(s AS INT) AS span, ws[s + 1] AS text, 'Font' AS font, CASE s WHEN 0 THEN 10 ELSE 12 END AS size FROM w, range(2) t(s)
"""


def roundtrip_dict(spark, sf_dir):
    """The nested form, taken apart again."""
    d = _read(_customers(spark, sf_dir)).page_dict
    lines = d.select("doc_id", "page", "width", F.explode("blocks").alias("b")).select("doc_id", "page", "width", F.col("b.number").alias("block"), F.posexplode("b.lines").alias("line", "l"))
    return lines.select("doc_id", "page", F.col("width").cast("int").alias("width"), "block", "line", F.size("l.spans").alias("n_spans"), F.get(F.col("l.spans"), 0)["text"].alias("text"))


ROUNDTRIP_DICT = f"WITH {CUSTOMERS} SELECT doc_id, CAST(n // 40 AS INT) AS page, 612 AS width, 0 AS block, CAST(n % 40 AS INT) AS line, 1 AS n_spans, text FROM rows_"


def roundtrip_lines(spark, sf_dir):
    return _read(_customers(spark, sf_dir)).lines.select("doc_id", "page", "block", "line", "text", k(F.col("x1") + 1e-6, 100).alias("x1"))


ROUNDTRIP_LINES = f"WITH {CUSTOMERS} SELECT doc_id, CAST(n // 40 AS INT) AS page, 0 AS block, CAST(n % 40 AS INT) AS line, text, {sql_k('50 + ' + _units('text') + ' / 100.0::DOUBLE + 1e-6', 100)} AS x1 FROM rows_"


def _glyph_rows(spark, sf_dir) -> DataFrame:
    """Glyphs scattered over pages, from orders' items."""
    i = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).cast("string").alias("doc_id"), F.lit(0).alias("page"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("h"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_returnflag", "l_discount", "l_extendedprice")
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    ox, oy = (F.col("l_suppkey") % 500).cast("double"), (F.col("l_quantity") * 9).cast("double")
    return i.select("doc_id", "page", seq.cast("int").alias("seq"), F.lit(65).alias("code"), F.when(F.col("l_discount") > 0.09, " ").otherwise(F.col("l_returnflag")).alias("text"), ox.alias("x0"), (oy - 8).alias("y0"), (ox + 5).alias("x1"), (oy + 2).alias("y1"), ox.alias("ox"), oy.alias("oy"), F.lit("Font").alias("font"), F.lit(20.0).alias("size"))


GLYPHS = """g AS (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq,
  CASE WHEN l_discount > 0.09 THEN ' ' ELSE l_returnflag END AS text, CAST(l_suppkey % 500 AS DOUBLE) AS ox, CAST(l_quantity * 9 AS DOUBLE) AS oy FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(oy, 1), ox, seq) AS i FROM g),
f AS (
  SELECT doc_id, i, oy AS base, 0 AS line_no FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN abs(s.oy - f.base) > 10 THEN s.oy ELSE f.base END, f.line_no + CASE WHEN abs(s.oy - f.base) > 10 THEN 1 ELSE 0 END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
n AS (SELECT s.*, f.line_no FROM s JOIN f USING (doc_id, i)),
l AS (SELECT doc_id, line_no, min(oy) - 8 AS top, max(oy) + 2 AS bottom FROM n GROUP BY ALL),
b AS (SELECT doc_id, line_no, CAST(sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS block FROM (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY doc_id ORDER BY line_no) > 8 THEN 1 ELSE 0 END AS gap FROM l)),
x AS (SELECT n.*, b.block, CAST(n.line_no - min(n.line_no) OVER (PARTITION BY n.doc_id, b.block) AS INT) AS line FROM n JOIN b USING (doc_id, line_no))"""


def cluster_lines(spark, sf_dir):
    s = grouping.structured(_glyph_rows(spark, sf_dir))
    return s.groupBy("doc_id", "block", "line").agg(F.count("*").alias("n"), F.min("seq").alias("low"), k(F.max("x1")).alias("x1"), k(F.min("y0")).alias("y0"))


CLUSTER_LINES = f"WITH RECURSIVE {GLYPHS} SELECT doc_id, block, line, count(*) AS n, CAST(min(seq) AS INT) AS low, {sql_k('max(ox + 5)')} AS x1, {sql_k('min(oy - 8)')} AS y0 FROM x GROUP BY ALL"


def cluster_words(spark, sf_dir):
    return grouping.words(_glyph_rows(spark, sf_dir)).select("doc_id", "block", "line", "word_no", "word", k(F.col("x0")).alias("x0"), k(F.col("x1")).alias("x1"))


CLUSTER_WORDS = f"""
WITH RECURSIVE {GLYPHS},
p AS (SELECT *, text = ' ' AS blank, lag(text = ' ', 1, true) OVER w AS after_blank, ox - lag(ox + 5) OVER w > 5 AS gap FROM x WINDOW w AS (PARTITION BY doc_id, block, line ORDER BY ox, seq)),
q AS (SELECT *, sum(CASE WHEN NOT blank AND (after_blank OR gap) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block, line ORDER BY ox, seq) - 1 AS word_no FROM p)
SELECT doc_id, block, line, CAST(word_no AS INT) AS word_no, string_agg(text, '' ORDER BY ox, seq) AS word, {sql_k("min(ox)")} AS x0, {sql_k("max(ox + 5)")} AS x1 FROM q WHERE NOT blank GROUP BY ALL
"""


def font_widths(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    fonts = {"helv": "helv", "bold": "hebo", "courier": "Courier", "times": "tiro"}
    return p.select("p_partkey", *[k(T.text_width(F.col("p_name"), F.lit(f), F.lit(12.0)), 100).alias(n) for n, f in fonts.items()], T.standard_name(F.lit("HeBo")).alias("base"), T.is_bold(F.lit("hebi")).alias("is_bold"), T.char_width(F.lit(65), F.lit("helv")).alias("a"))


FONT_WIDTHS = "SELECT p_partkey, " + ", ".join(f"{sql_k(f'{u} / 1000.0::DOUBLE * 12', 100)} AS {n}" for n, u in (("helv", _units("p_name")), ("bold", _units("p_name", _BOLD)), ("courier", f"length(p_name) * {COURIER}"), ("times", _units("p_name")))) + ", 'Helvetica-Bold' AS base, true AS is_bold, 667 AS a FROM part"


def text_wrap(spark, sf_dir):
    """The names of a brand's parts, wrapped at 150 points."""
    p = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ").alias("t"))
    lines = T.wrap(F.col("t"), F.lit("helv"), F.lit(10.0), F.lit(150.0))
    return p.select("p_brand", F.posexplode(lines).alias("line", "text"))


TEXT_WRAP = f"""
WITH RECURSIVE p AS (SELECT p_brand, string_split(string_agg(p_name, ' ' ORDER BY p_partkey), ' ') AS ws FROM part GROUP BY 1),
w AS (SELECT p_brand, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM p), u AS (SELECT *, CAST({_units("word")} AS BIGINT) AS u FROM w),
f AS (
  SELECT p_brand, i, u AS held, 0 AS line FROM u WHERE i = 1
  UNION ALL
  SELECT u.p_brand, u.i, CASE WHEN f.held + 278 + u.u > 15000 THEN u.u ELSE f.held + 278 + u.u END, f.line + CASE WHEN f.held + 278 + u.u > 15000 THEN 1 ELSE 0 END FROM f JOIN u ON u.p_brand = f.p_brand AND u.i = f.i + 1)
SELECT p_brand, CAST(line AS INT) AS line, string_agg(word, ' ' ORDER BY i) AS text FROM f JOIN u USING (p_brand, i) GROUP BY ALL
"""


def layout_place(spark, sf_dir):
    """One line of each part's type in boxes of three alignments each way."""
    align, valign = F.element_at(F.array(*map(F.lit, ("left", "center", "right"))), (F.col("p_partkey") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("top", "center", "bottom"))), (F.col("p_size") % 3 + 1).cast("int"))
    c = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("box").alias("kind"), F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(410.0).alias("x1"), F.lit(220.0).alias("y1"), F.col("p_type").alias("text"), align.alias("align"), valign.alias("valign"), F.lit(12.0).alias("fontsize"))
    return authoring.laid_out(c).select(F.col("doc_id").alias("p_partkey"), "line", "text", *[k(F.col(x) + 1e-6, 100).alias(n) for x, n in (("x", "x"), ("baseline", "baseline"), ("used.x0", "ux0"), ("used.y0", "uy0"), ("used.x1", "ux1"), ("used.y1", "uy1"))])


LAYOUT_PLACE = f"""
WITH p AS (SELECT *, {_units("p_type")} / 1000.0::DOUBLE * 12 AS w FROM part),
q AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 10 + (400 - w) / 2 ELSE 410 - w END AS x, CASE p_size % 3 WHEN 0 THEN 20 WHEN 1 THEN 20 + (200 - 14.4::DOUBLE) / 2 ELSE 220 - 14.4::DOUBLE END AS top FROM p)
SELECT p_partkey, 0 AS line, p_type AS text, {sql_k("x + 1e-6", 100)} AS x, {sql_k("top + 9.6::DOUBLE + 1e-6", 100)} AS baseline, {sql_k("x + 1e-6", 100)} AS ux0, {sql_k("top + 1e-6", 100)} AS uy0, {sql_k("x + w + 1e-6", 100)} AS ux1, {sql_k("top + 14.4::DOUBLE + 1e-6", 100)} AS uy1 FROM q
"""


def text_operators(spark, sf_dir):
    """The strings of drawing operators."""
    p = _t(spark, sf_dir, "part")
    draw = T.draw_operator(F.col("p_retailprice"), (F.col("p_size") / 2).cast("double"), F.concat(F.lit("a(b)\\"), "p_name"), F.lit("F1"), F.lit(11.0))
    return p.select("p_partkey", draw.alias("draw"), T.color_operator(F.lit(0.5), F.lit(0.25), F.lit(1.0)).alias("color"), T.number(F.lit(-0.00001)).alias("zero"), F.concat_ws(",", *[T.cmyk_to_rgb(*[((F.col("p_partkey") * m) % 256).cast("int") for m in (1, 3, 5, 7)])[c].cast("string") for c in "rgb"]).alias("rgb"))


TEXT_OPERATORS = r"""
SELECT p_partkey, 'q BT /F1 11 Tf ' || (CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.4f', p_retailprice), '0'), '.') END) || ' ' ||
  (CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END) || ' Td (a\(b\)\\' || p_name || ') Tj ET Q' AS draw, '0.5 0.25 1 rg' AS color, '0' AS zero,
  array_to_string([CAST((255 - p_partkey * m % 256) * (255 - p_partkey * 7 % 256) // 255 AS VARCHAR) for m in [1, 3, 5]], ',') AS rgb FROM part
"""


def navigation_toc(spark, sf_dir):
    c = Corpus(corpora.navigated(_nations(spark, sf_dir)))
    return c.toc.select("doc_id", "seq", "level", "title", "page", "kind", "dest_page", k(F.col("to.x")).alias("x"), k(F.col("to.y")).alias("y"), "uri")


_RANKED = "n AS (SELECT r_name AS doc_id, n_name AS name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY r_name) AS INT) AS c FROM nation JOIN region ON n_regionkey = r_regionkey)"
NAVIGATION_TOC = f"""
WITH {_RANKED} SELECT doc_id, i + 1 AS seq, 2 AS level, name AS title, i + 1 AS page, 'goto' AS kind, i AS dest_page, CASE WHEN i % 2 = 1 THEN 10000 ELSE 0 END::BIGINT AS x, (700 - i) * 1000::BIGINT AS y, NULL::VARCHAR AS uri FROM n
UNION ALL SELECT DISTINCT doc_id, 0, 1, doc_id, 1, 'goto', 0, NULL::BIGINT, NULL::BIGINT, NULL FROM n
"""


def navigation_links(spark, sf_dir):
    c = Corpus(corpora.navigated(_nations(spark, sf_dir)))
    return c.links.select("doc_id", "page", "seq", "kind", "dest_page", "uri", *[k(F.col(f"from.{x}")).alias(x) for x in ("x0", "y0", "x1", "y1")])


NAVIGATION_LINKS = f"""
WITH {_RANKED} SELECT doc_id, i AS page, 0 AS seq, 'goto' AS kind, (i + 1) % c AS dest_page, NULL::VARCHAR AS uri, 10000::BIGINT AS x0, (760 - i) * 1000::BIGINT AS y0, 110000::BIGINT AS x1, (790 - i) * 1000::BIGINT AS y1 FROM n
UNION ALL SELECT doc_id, i, 1, 'goto', i, NULL, 10000, 720000, 110000, 750000 FROM n
UNION ALL SELECT doc_id, i, 2, 'uri', NULL, 'https://example.com/' || replace(name, ' ', '-'), 10000, 680000, 110000, 710000 FROM n
"""


def navigation_annots(spark, sf_dir):
    c = Corpus(corpora.navigated(_nations(spark, sf_dir)))
    return c.annots.where("type <> 'Link'").select("doc_id", "page", "seq", "type", "content", "title", "name", k(F.col("rect.y0")).alias("y0"))


NAVIGATION_ANNOTS = f"WITH {_RANKED} SELECT doc_id, i AS page, 3 AS seq, 'Text' AS type, name AS content, 'folia' AS title, 'n' || i AS name, 700000::BIGINT AS y0 FROM n"


def navigation_named(spark, sf_dir):
    """Names looked up in the documents' tables of destinations, unknown ones too."""
    n = _nations(spark, sf_dir)
    c = Corpus(corpora.navigated(n))
    asked = n.select("doc_id", "name").union(n.select("doc_id", F.concat("name", F.lit("?")))).union(n.select("doc_id", F.lit("start")).distinct())
    return navigation.named_destinations(asked, c.destinations).select("doc_id", "name", "dest_page", k(F.col("to.y")).alias("y"))


NAVIGATION_NAMED = f"WITH {_RANKED} SELECT doc_id, name, i AS dest_page, (700 - i) * 1000::BIGINT AS y FROM n UNION ALL SELECT doc_id, name || '?', NULL, NULL FROM n UNION ALL SELECT DISTINCT doc_id, 'start', 0, NULL::BIGINT FROM n"


def object_graph(spark, sf_dir):
    """References joined to their targets; pages found by the objects that links and kids name."""
    c = Corpus(corpora.navigated(_nations(spark, sf_dir)))
    edges = navigation.dereference(c.objects)
    pages = navigation.page_index(edges.select("doc_id", F.col("ref_num").alias("obj_num")), c.pages)
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_refs"), F.count("page").alias("to_pages"), F.countDistinct("page").alias("pages"))


OBJECT_GRAPH = f"""
WITH {_RANKED}, d AS (SELECT doc_id, count(*) AS c FROM n GROUP BY 1)
SELECT doc_id, c + (1 + 1 + 1 + 1) + 1 + 1 + 1 + c + (c * 2 + c + c) + (c - c // 2) + (c - 1) AS n_refs, c + 1 + c + c + (c - c // 2) AS to_pages, c AS pages FROM d
"""


def _page_rows(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders").where("o_orderkey is not null")
    return o.select((F.col("o_custkey") % 200).cast("string").alias("doc_id"), F.col("o_orderkey").alias("pos"), (100 + F.col("o_orderkey") % 400).alias("w"), (200 + F.col("o_custkey") % 300).alias("h"), ((F.col("o_orderkey") % 9 - 4) * 90).alias("turn"))


def page_geometry(spark, sf_dir):
    c = Corpus(corpora.boxed(_page_rows(spark, sf_dir)))
    return c.pages.select("doc_id", "page", "rotation", F.col("mediabox.x1").cast("int").alias("mx1"), F.col("cropbox.x0").cast("int").alias("cx0"), F.col("cropbox.y1").cast("int").alias("cy1"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))


_PAGES = "p AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS INT) AS page, 100 + o_orderkey % 400 AS w, 200 + o_custkey % 300 AS h, CAST(((o_orderkey % 9 - 4) * 90 % 360 + 360) % 360 AS INT) AS rotation FROM orders), c AS (SELECT *, CASE page % 2 WHEN 1 THEN 10 ELSE 0 END AS a, CASE page % 2 WHEN 1 THEN w - 20 ELSE w END AS cw, CASE page % 2 WHEN 1 THEN h - 30 ELSE h END AS ch FROM p)"
PAGE_GEOMETRY = f"WITH {_PAGES} SELECT doc_id, page, rotation, CAST(w AS INT) AS mx1, a AS cx0, CAST(a + ch AS INT) AS cy1, CAST(CASE WHEN rotation IN (90, 270) THEN ch ELSE cw END AS INT) AS width, CAST(CASE WHEN rotation IN (90, 270) THEN cw ELSE ch END AS INT) AS height FROM c"


def page_slices(spark, sf_dir):
    """The last page of each document, and what the pages tell about it: counts, largest page, pages by turn."""
    c = Corpus(corpora.boxed(_page_rows(spark, sf_dir)))
    last = c.page(-1).select("doc_id", F.col("page").alias("last_page"))
    stats = c.pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("width").cast("int").alias("widest"), F.min(F.struct((-F.col("height")).alias("h"), "page"))["page"].alias("tallest"), F.sum((F.col("rotation") == 90).cast("long")).alias("turned"))
    return stats.join(last, "doc_id")


PAGE_SLICES = f"WITH {_PAGES}, x AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN ch ELSE cw END AS wd, CASE WHEN rotation IN (90, 270) THEN cw ELSE ch END AS ht FROM c) SELECT doc_id, count(*) AS n, CAST(max(wd) AS INT) AS widest, arg_min(page, (-ht, page)) AS tallest, count(*) FILTER (WHERE rotation = 90) AS turned, max(page) AS last_page FROM x GROUP BY 1"


def page_tree(spark, sf_dir):
    """What regions' nodes say, inherited by nations and customers: the nearest ancestor that has a value counts."""
    nation, customer = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer")
    top = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("node")).distinct().select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("turn"), F.lit(612).alias("box"))
    mid = nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, 90), F.lit(None).cast("int"))
    leaf = customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit(None).cast("int"), F.when(F.col("c_custkey") % 3 == 0, 100))
    nodes = top.union(mid).union(leaf).withColumn("doc_id", F.lit("tree"))
    return navigation.inherited(nodes, ["turn", "box"]).select("node", "turn", "box")


PAGE_TREE = """
SELECT 'c' || c_custkey AS node, CASE WHEN c_nationkey % 2 = 0 THEN 90 ELSE 0 END AS turn, CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 612 END AS box FROM customer
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 90 ELSE 0 END, 612 FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, 0, 612 FROM nation
"""


def metadata(spark, sf_dir):
    """Titles in UTF-16 from whole texts of documents, authors in Latin-1; the SQL shows the first characters of a title."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.col("text").alias("title"), F.concat(F.lit("é "), "source").alias("author"), F.lit("20240101").alias("day"))
    return Corpus(corpora.titled(d)).documents.select("doc_id", "version", "page_count", "encrypted", "metadata.format", F.substring("metadata.title", 1, 40).alias("title"), *[f"metadata.{x}" for x in ("author", "subject", "creationDate", "encryption")])


METADATA = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, '1.7' AS version, 0 AS page_count, false AS encrypted, 'PDF 1.7' AS format, text[1:40] AS title, 'é ' || source AS author, NULL::VARCHAR AS subject, 'D:20240101' AS creationDate, NULL::VARCHAR AS encryption FROM documents"


def filters_roundtrip(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.col("text").alias("body"))
    return Corpus(corpora.filtered(d)).contents.select("doc_id", "page", F.md5(F.rtrim(F.decode("contents", "UTF-8")).cast("binary")).alias("digest"))


FILTERS_ROUNDTRIP = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(k AS INT) AS page, md5(rtrim(text, ' ')) AS digest FROM documents, range(6) t(k)"


def fonts_decode(spark, sf_dir):
    """Names shown through a map of codes, named glyphs and two-byte codes."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("name"))
    return Corpus(corpora.mapped(n)).lines.select("doc_id", "block", "text")


FONTS_DECODE = "SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(k AS INT) AS block, n_name AS text FROM nation, range(3) t(k)"


def decrypt(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    rows = n.select(F.explode(F.array(*map(F.lit, corpora.METHODS))).alias("method"), "n_nationkey", "name").select(F.concat_ws("-", "method", "n_nationkey").alias("doc_id"), "method", "name")
    c = Corpus(corpora.encrypted(rows))
    return c.documents.select("doc_id", "encrypted", "metadata.title", "metadata.encryption", "error_class").join(c.text.select("doc_id", "text"), "doc_id")


DECRYPT = "SELECT m || '-' || n_nationkey AS doc_id, true AS encrypted, n_name AS title, 'Standard' AS encryption, NULL::VARCHAR AS error_class, n_name AS text FROM nation, unnest([" + ", ".join(f"'{m}'" for m in corpora.METHODS) + "]) t(m)"


def _pixels(spark, sf_dir) -> DataFrame:
    px = F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 1000), F.lit(256)).cast("int"))
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), px.alias("pixels"))


PIXELS = "px AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, [CAST(((CAST(floor(x::DOUBLE * 1000) AS BIGINT) % 256) + 256) % 256 AS BIGINT) for x in embedding] AS p FROM embeddings)"


def images_list(spark, sf_dir):
    return Corpus(corpora.pictured(_pixels(spark, sf_dir))).images.drop("page")


IMAGES_LIST = f"""
WITH {PIXELS}, i(seq, xref, name, width, height, bpc, colorspace, filter) AS (VALUES (0, 6::BIGINT, 'Im0', 8, 8, 8, 'DeviceGray', 'FlateDecode'), (1, 7, 'Im1', 7, 3, 8, 'DeviceRGB', 'FlateDecode'), (2, 8, 'Im2', 4, 4, 8, 'DeviceCMYK', 'FlateDecode'), (3, 9, 'Im3', 8, 8, 8, 'Indexed', 'FlateDecode'), (4, 10, 'Im4', 4, 1, 8, 'DeviceRGB', 'DCTDecode'), (5, 11, 'Inner', 16, 4, 8, 'DeviceGray', 'FlateDecode'))
SELECT doc_id, i.* FROM px, i
"""


def images_extract(spark, sf_dir):
    """The images' files, decoded to samples; those of jpg data stay as they are."""
    import pyarrow as pa

    def samples(batches):
        from folia.pdf.images import unpng

        for b in batches:
            out = [list(unpng(x)[4]) if e == "png" else list(x) for x, e in zip(b.column("image").to_pylist(), b.column("ext").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("xref"), b.column("ext"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "xref", "ext", "s"])

    c = Corpus(corpora.pictured(_pixels(spark, sf_dir)))
    d = c.image_data.select("doc_id", "xref", "ext", "image").mapInArrow(samples, "doc_id string, xref bigint, ext string, s array<int>")
    return d.select("doc_id", "xref", "ext", F.size("s").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: x.cast("string")), ",").cast("binary")).alias("digest"))


IMAGES_EXTRACT = f"""
WITH {PIXELS}, s AS (
  SELECT doc_id, 6 AS xref, 'png' AS ext, p AS s FROM px UNION ALL SELECT doc_id, 7, 'png', p[1:63] FROM px UNION ALL SELECT doc_id, 11, 'png', p FROM px
  UNION ALL SELECT doc_id, 8, 'png', flatten([[(255 - p[4 * i + 1]) * (255 - p[4 * i + 4]) // 255, (255 - p[4 * i + 2]) * (255 - p[4 * i + 4]) // 255, (255 - p[4 * i + 3]) * (255 - p[4 * i + 4]) // 255] for i in range(16)]) FROM px
  UNION ALL SELECT doc_id, 9, 'png', flatten([[37 * x % 256, (37 * x + 85) % 256, (37 * x + 170) % 256] for x in p]) FROM px
  UNION ALL SELECT doc_id, 10, 'jpg', [255, 216, 255, 224]::BIGINT[] || p || [255, 217]::BIGINT[] FROM px)
SELECT doc_id, CAST(xref AS BIGINT) AS xref, ext, CAST(len(s) AS INT) AS n, md5(array_to_string([CAST(x AS VARCHAR) for x in s], ',')) AS digest FROM s
"""


def pixmaps(spark, sf_dir):
    """Pixmaps' attributes and one pixel of each, after a PNG was made of it and read again."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, pixels in zip(frame["doc_id"], frame["pixels"]):
                width, height, _, _, samples = unpng(Pixmap(4, 5, 3, bytes(map(int, pixels))).to_png())
                p = Pixmap(width, height, 3, samples)
                rows.append((doc_id, p.stride, p.alpha, p.colorspace, *p.pixel(int(doc_id) % 4, int(doc_id) % 5)))
            yield pd.DataFrame(rows, columns=["doc_id", "stride", "alpha", "colorspace", "c0", "c1", "c2"])

    return _pixels(spark, sf_dir).select("doc_id", "pixels").mapInPandas(run, "doc_id string, stride int, alpha boolean, colorspace string, c0 int, c1 int, c2 int")


PIXMAPS = f"WITH {PIXELS}, q AS (SELECT *, (vec % 5) * 12 + (vec % 4) * 3 AS a FROM (SELECT *, CAST(doc_id AS INT) AS vec FROM px)) SELECT doc_id, 12 AS stride, false AS alpha, 'DeviceRGB' AS colorspace, CAST(p[a + 1] AS INT) AS c0, CAST(p[a + 2] AS INT) AS c1, CAST(p[a + 3] AS INT) AS c2 FROM q"


def stamp_incremental(spark, sf_dir):
    """Regions' documents stamped on page 0; those with an odd number of letters are left alone, byte for byte."""
    n = _nations(spark, sf_dir).select("doc_id", F.col("pos").alias("n"), F.col("name").alias("text"))
    files = authoring.write_documents(_sheet(n)).persist()
    edits = n.select("doc_id").distinct().where(F.length("doc_id") % 2 == 0).select("doc_id", F.lit("box").alias("kind"), F.lit(300.0).alias("x0"), F.lit(700.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(780.0).alias("y1"), F.concat(F.lit("STAMP "), "doc_id").alias("text"), F.lit("hebo").alias("fontname"))
    done = authoring.stamp(files, edits)
    text = Corpus(done).text.select("doc_id", F.regexp_replace("text", "\\s+", " ").alias("text"))
    same = done.join(files.withColumnRenamed("content", "before"), "doc_id").select("doc_id", (F.col("content") == F.col("before")).alias("same"), (F.col("content").startswith(F.col("before"))).alias("appended"), "error")
    return text.join(same, "doc_id")


STAMP_INCREMENTAL = """
SELECT r_name AS doc_id, string_agg(n_name, ' ' ORDER BY n_nationkey) || CASE WHEN length(r_name) % 2 = 0 THEN ' STAMP ' || r_name ELSE '' END AS text, length(r_name) % 2 = 1 AS same, true AS appended, NULL::VARCHAR AS error
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
"""


def compressed_objects(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("name"))
    c = Corpus(corpora.compressed(n))
    counts = c.objects.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("in_objstm").cast("long")).alias("packed"))
    return c.documents.select("doc_id", "page_count", "metadata.title").join(counts, "doc_id")


COMPRESSED_OBJECTS = "SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 1 AS page_count, n_name AS title, 6::BIGINT AS n, 4::BIGINT AS packed FROM nation"


def latest_definitions(spark, sf_dir):
    """The last definition of an object counts, in files and in tables."""
    r = _nations(spark, sf_dir)
    files = corpora.revised(r)
    index = tables.object_index(files).where("obj_num = 3").select("doc_id", F.col("definitions").alias("n"))
    rel = navigation.latest(r.select("doc_id", F.lit(3).alias("obj_num"), "pos", "name"), "pos").select("doc_id", F.col("name").alias("by_table"))
    return Corpus(files).documents.select("doc_id", "metadata.title").join(index, "doc_id").join(rel, "doc_id").join(files.select("doc_id", tables.header_version(F.col("content")).alias("header")), "doc_id")


LATEST_DEFINITIONS = f"WITH {_RANKED} SELECT doc_id, name AS title, c::BIGINT AS n, name AS by_table, '1.7' AS header FROM n WHERE i = c - 1"


def error_taxonomy(spark, sf_dir):
    """Bytes that are no PDF, empty ones, and a document that needs a password: rows with an error, never a failed job."""
    n = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    bad = n.select(F.concat(F.lit("text"), "r_regionkey").alias("doc_id"), F.encode("r_name", "UTF-8").alias("content")).union(n.select(F.concat(F.lit("none"), "r_regionkey"), F.lit(None).cast("binary")))
    locked = F.lit("%PDF-1.4\n1 0 obj\n<</Type /Catalog>>\nendobj\n2 0 obj\n<</Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O (oooooooooooooooooooooooooooooooo) /U (uuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuu)>>\nendobj\ntrailer\n<</Root 1 0 R /Encrypt 2 0 R>>")
    bad = bad.union(n.select(F.concat(F.lit("locked"), "r_regionkey"), F.encode(locked, "UTF-8")))
    c = Corpus(bad)
    return c.documents.select("doc_id", "page_count", "error_class").join(c.glyphs.groupBy("doc_id").agg(F.count("*").alias("n_glyphs")), "doc_id", "left")


ERROR_TAXONOMY = "SELECT k || r_regionkey AS doc_id, NULL::INT AS page_count, e AS error_class, NULL::BIGINT AS n_glyphs FROM region, (VALUES ('text', 'FileData'), ('none', 'FileData'), ('locked', 'Encrypted')) t(k, e)"


def render_unavailable(spark, sf_dir):
    z = render.zoom(dpi=144)
    return _t(spark, sf_dir, "region").select("r_name", F.lit(render.available()).alias("available"), F.lit(render.unavailable_reason()).alias("reason"), F.lit(z[0]).alias("zoom"))


RENDER_UNAVAILABLE = f"SELECT r_name, false AS available, '{render.REASON}' AS reason, 2.0::DOUBLE AS zoom FROM region"


def sql_lateral(spark, sf_dir):
    """Table functions in SQL: the words of each document's glyphs, counted."""
    from folia.sources.datasource import register

    register(spark)
    files = authoring.write_documents(_sheet(_customers(spark, sf_dir)))
    files.createOrReplaceTempView("folia_files")
    return spark.sql("SELECT p.doc_id, count(*) AS pages, CAST(sum(p.width) AS BIGINT) AS widths FROM folia_files f, LATERAL pdf_pages(f.doc_id, f.content) p GROUP BY p.doc_id")


SQL_LATERAL = f"WITH {CUSTOMERS} SELECT doc_id, max(n) // 40 + 1 AS pages, CAST((max(n) // 40 + 1) * 612 AS BIGINT) AS widths FROM rows_ GROUP BY 1"


def text_modes(spark, sf_dir):
    """Each mode of text by its name."""
    c = _read(_nations(spark, sf_dir).select("doc_id", F.col("pos").alias("n"), F.col("name").alias("text")))
    parts = [grouping.get_text(c, m).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("mode", F.lit(m)) for m in ("text", "words", "blocks", "dict", "rawdict")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TEXT_MODES = f"""
WITH {_RANKED}, d AS (SELECT r_name AS doc_id, n_nationkey AS k, len(string_split(n_name, ' ')) AS w FROM nation JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT *, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) > 1 AS gap FROM d)
SELECT doc_id, 1::BIGINT AS n, m AS mode FROM (SELECT DISTINCT doc_id FROM d), unnest(['text', 'dict', 'rawdict']) t(m)
UNION ALL SELECT doc_id, CAST(sum(w) AS BIGINT), 'words' FROM d GROUP BY 1 UNION ALL SELECT doc_id, count(*) FILTER (WHERE gap) + 1, 'blocks' FROM b GROUP BY 1
"""


def _each_customer(spark, sf_dir, *columns):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), *columns)


def text_operators_shown(spark, sf_dir):
    """Where each glyph of each text operator's page is, in ten-thousandths; a document per customer."""
    k = F.col("c_custkey")
    c = Corpus(corpora.shown(_each_customer(spark, sf_dir, (40 + k % 7).cast("int").alias("x"), (700 - k % 11).cast("int").alias("y"), (10 + k % 3).cast("int").alias("s"))))
    return c.glyphs.select("doc_id", "page", "seq", "text", F.round(F.col("ox") * 10000).cast("long").alias("ox"), F.round(F.col("oy") * 10000).cast("long").alias("oy"))


TEXT_OPERATORS_SHOWN = """
WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 40 + c_custkey % 7 AS x, 700 - c_custkey % 11 AS y, 10 + c_custkey % 3 AS s FROM customer)
SELECT doc_id, CAST(page AS INT) AS page, CAST(seq AS INT) AS seq, text, CAST(round((x + dx) * 10000) AS BIGINT) AS ox, CAST(round((800 - y - dy) * 10000) AS BIGINT) AS oy
FROM d, LATERAL (VALUES
  (0, 0, 'A', 0, 0), (0, 1, ' ', 0.667 * s, 0), (0, 2, 'B', 0.945 * s, 0),
  (1, 0, 'A', 5, 7), (1, 1, ' ', 5 + 1.334 * s, 7), (1, 2, 'B', 5 + 1.89 * s, 7),
  (2, 0, 'A', 3, -14), (2, 1, 'B', 3, -28),
  (3, 0, 'A', 0, -12), (3, 1, 'B', 0, -24),
  (4, 0, 'A', 0, -12), (4, 1, ' ', 0.667 * s + 1, -12), (4, 2, 'B', 0.945 * s + 6, -12),
  (5, 0, 'A', 0, 0), (5, 1, ' ', (0.667 * s + 1) / 2, 0), (5, 2, 'B', (0.945 * s + 6) / 2, 0),
  (6, 0, 'A', 0, 3),
  (7, 0, 'A', 0, 0), (7, 1, 'B', 0.547 * s, 0), (7, 2, 'A', 1.464 * s, 0),
  (8, 0, 'A', 0, 0),
  (9, 0, 'A', 0, 0), (9, 1, 'B', 0.5 * s, 0), (9, 2, 'C', 1.25 * s, 0),
  (10, 0, 'A', 0, 0), (10, 1, 'B', 0.4 * s, 0), (10, 2, 'C', 1.2 * s, 0),
  (11, 0, 'A', 0, 0)
) AS t(page, seq, text, dx, dy)
"""


def text_separators(spark, sf_dir):
    """Texts with their line ends and empty lines as they are, a blank where a gap has none, and the size of a turned page in dict mode."""
    c = Corpus(corpora.spaced(_each_customer(spark, sf_dir, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("more"))))
    return c.text.join(c.page_dict.select("doc_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")), "doc_id")


TEXT_SEPARATORS = "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 0 AS page, c_name || chr(10) || c_mktsegment || chr(10) || chr(10) || 'A B' AS text, 600 AS width, 800 AS height FROM customer"


def undecodable_pages(spark, sf_dir):
    """Pages whose contents can't be decoded have an error, all other pages their text."""
    c = Corpus(corpora.undecodable(_each_customer(spark, sf_dir, (F.col("c_custkey") % 5).cast("int").alias("bad"))))
    errors = c.errors.where("part = 'contents'").select("doc_id", "page", F.col("error_class").alias("listed"))
    return c.contents.join(c.text, ["doc_id", "page"]).join(errors, ["doc_id", "page"], "left").select("doc_id", "page", F.col("contents").isNull().alias("lost"), "error_class", "listed", "text")


UNDECODABLE_PAGES = """
WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(k AS INT) AS page, (c_custkey % 5 = k) OR (c_custkey % 5 = 3 AND k = 0) AS lost FROM customer, range(3) t(k))
SELECT doc_id, page, lost, CASE WHEN lost THEN 'Malformed' END AS error_class, CASE WHEN lost THEN 'Malformed' END AS listed, CASE WHEN lost THEN '' ELSE 'page ' || page END AS text FROM p
"""


def late_types(spark, sf_dir):
    """Pages in object streams whose type comes after thousands of bytes."""
    c = Corpus(corpora.late_type(_each_customer(spark, sf_dir, (F.col("c_custkey") % 4 * 2000).cast("int").alias("filler"))))
    return c.documents.select("doc_id", "page_count", "error_class")


LATE_TYPES = "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 1 AS page_count, NULL::VARCHAR AS error_class FROM customer"


def deep_inheritance(spark, sf_dir):
    """Customers of a nation as one branch, each under the one before: what the nearest of those above says counts, however far up."""
    before = F.lag("c_custkey").over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    turn = F.when(F.col("c_custkey") % 100 == 0, F.col("c_custkey"))
    nodes = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), F.col("c_custkey").alias("node"), before.alias("parent"), turn.alias("turn"))
    return navigation.inherited(nodes, ["turn"]).select("doc_id", "node", "turn")


DEEP_INHERITANCE = "SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_custkey AS node, last_value(CASE WHEN c_custkey % 100 = 0 THEN c_custkey END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS turn FROM customer"


def whole_titles(spark, sf_dir):
    """Digests of titles that are whole texts of documents."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.col("text").alias("title"), F.col("source").alias("author"), F.lit("20240101").alias("day"))
    return Corpus(corpora.titled(d)).documents.select("doc_id", F.md5(F.col("metadata.title").cast("binary")).alias("digest"))


WHOLE_TITLES = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest FROM documents"


_ALL = (
    (flagship_roundtrip, FLAGSHIP), (roundtrip_text, ROUNDTRIP_TEXT), (roundtrip_words, ROUNDTRIP_WORDS), (roundtrip_lines, ROUNDTRIP_LINES), (roundtrip_blocks, ROUNDTRIP_BLOCKS), (roundtrip_spans, ROUNDTRIP_SPANS), (roundtrip_dict, ROUNDTRIP_DICT), (text_modes, TEXT_MODES),
    (cluster_lines, CLUSTER_LINES), (cluster_words, CLUSTER_WORDS), (font_widths, FONT_WIDTHS), (text_wrap, TEXT_WRAP), (layout_place, LAYOUT_PLACE), (text_operators, TEXT_OPERATORS),
    (navigation_toc, NAVIGATION_TOC), (navigation_links, NAVIGATION_LINKS), (navigation_annots, NAVIGATION_ANNOTS), (navigation_named, NAVIGATION_NAMED), (object_graph, OBJECT_GRAPH),
    (page_geometry, PAGE_GEOMETRY), (page_slices, PAGE_SLICES), (page_tree, PAGE_TREE), (metadata, METADATA), (filters_roundtrip, FILTERS_ROUNDTRIP), (fonts_decode, FONTS_DECODE), (decrypt, DECRYPT),
    (images_list, IMAGES_LIST), (images_extract, IMAGES_EXTRACT), (pixmaps, PIXMAPS), (stamp_incremental, STAMP_INCREMENTAL), (compressed_objects, COMPRESSED_OBJECTS), (latest_definitions, LATEST_DEFINITIONS), (error_taxonomy, ERROR_TAXONOMY), (render_unavailable, RENDER_UNAVAILABLE), (sql_lateral, SQL_LATERAL),
    (text_operators_shown, TEXT_OPERATORS_SHOWN), (text_separators, TEXT_SEPARATORS), (undecodable_pages, UNDECODABLE_PAGES), (late_types, LATE_TYPES), (deep_inheritance, DEEP_INHERITANCE), (whole_titles, WHOLE_TITLES),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL}
