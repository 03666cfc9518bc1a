"""The relational side: geometry, layout, grouping, sources, sinks and streams."""

import math

import pytest
from pyspark.sql import functions as F

from folia import api
from folia.functions import geometry as G
from folia.functions import text as T
from folia.operators import authoring, grouping, navigation
from folia.pdf import fonts
from folia.pdf import layout as L
from folia.sources import tables
from folia.sources.tables import Corpus, read_pdf


def value(spark, column):
    def plain(v):
        return tuple(plain(x) for x in v) if hasattr(v, "__fields__") or isinstance(v, list) else v

    return plain(spark.range(1).select(column.alias("v")).first().v)


def test_geometry_of_fixed_cases(spark):
    p = G.point
    cases = [
        (G.length(p(3, 4)), 5.0), (G.distance(p(0, 0), p(3, 4)), 5.0), (G.add(p(1, 2), p(3, 4)), (4, 6)), (G.subtract(p(5, 5), p(2, 1)), (3, 4)), (G.scale(p(1, 2), 3), (3, 6)), (G.shift(p(1, 2), 3), (4, 2)),
        (G.unit(p(0, 0)), (0, 0)), (G.abs_unit(p(-3, 4)), (0.6, 0.8)), (G.transform_point(p(1, 1), G.translation(10, 20)), (11, 21)), (G.matrix(), (0,) * 6), (G.scaling(2, 3), (2, 0, 0, 3, 0, 0)),
        (G.transform_point(p(1, 1), G.concat(G.scaling(2, 2), G.translation(10, 0))), (12, 2)), (G.concat(G.matrix(2, 0, 0, 4, 5, 6), G.inverse(G.matrix(2, 0, 0, 4, 5, 6))), (1, 0, 0, 1, 0, 0)),
        (G.pre_translate(G.identity(), 3, 4), (1, 0, 0, 1, 3, 4)), (G.pre_rotate(G.identity(), 90), (0, 1, -1, 0, 0, 0)), (G.pre_shear(G.identity(), 2, 3), (1, 3, 2, 1, 0, 0)), (G.pre_scale(G.identity(), 2, 3), (2, 0, 0, 3, 0, 0)),
        (G.width(G.rect(0, 0, 100, 50)), 100), (G.height(G.rect(0, 5, 100, 0)), 0), (G.irect_height(G.irect(G.rect(0, 5.9, 1, 0.2))), -5), (G.intersection(G.rect(0, 0, 100, 50), G.rect(50, 25, 150, 75)), (50, 25, 100, 50)),
        (G.union(G.rect(0, 0, 100, 50), G.rect(50, 25, 150, 75)), (0, 0, 150, 75)), (G.union(G.rect(0, 0, 1, 1), G.rect()), (0, 0, 1, 1)), (G.include_point(G.rect(0, 0, 10, 10), p(20, 5)), (0, 0, 20, 10)), (G.include_point(G.rect(), p(2, 5)), (2, 5, 2, 5)),
        (G.round_out(G.rect(0.2, 0.8, 10.1, 10.9)), (0, 0, 11, 11)), (G.transform_rect(G.rect(0, 0, 10, 10), G.scaling(2, 3)), (0, 0, 20, 30)), (G.contains_rect(G.rect(0, 0, 100, 50), G.rect(10, 10, 20, 20)), True), (G.intersects(G.rect(0, 0, 1, 1), G.rect(1, 0, 2, 1)), False),
        (G.is_infinite(G.rect(0, 0, math.inf, 1)), True), (G.is_rectangular(G.rect_quad(G.rect(0, 0, 1, 2))), True), (G.is_empty_quad(G.rect_quad(G.rect())), True), (G.quad_rect(G.rect_quad(G.rect(1, 2, 3, 4))), (1, 2, 3, 4)),
        (G.rect_array(G.rect(1, 2, 3, 4)), (1, 2, 3, 4)), (G.label("Point", F.lit(1.0), F.lit(2.5)), "Point(1, 2.5)"), (G.flip(G.rect(1, 2, 3, 5), 100), (1, 95, 3, 98)),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, expected) in enumerate(cases):
        got = row[f"c{i}"]
        assert (tuple(got) if isinstance(expected, tuple) else got) == (pytest.approx(expected, abs=1e-9) if not isinstance(expected, (bool, str)) else expected), i


def test_singular_matrices(spark):
    assert value(spark, G.try_inverse(G.matrix())) is None
    with pytest.raises(Exception, match="no inverse"):
        value(spark, G.inverse(G.matrix(1, 2, 2, 4)))


TEXTS = ["", "one", "one two three four five", " a  b ", "x\n\ny z", "a very long line that has to be wrapped several times to fit (really)", "éàü ß"]


def test_layout_is_the_same_in_both_forms(spark):
    rows = [(i, t, f, float(s), float(w)) for i, (t, f, s, w) in enumerate((t, f, s, w) for t in TEXTS for f in ("helv", "hebo", "Courier", "tiro") for s in (9, 20) for w in (0, 60, 200))]
    df = spark.createDataFrame(rows, "i int, t string, f string, s double, w double")
    made = df.select("i", T.text_width(F.col("t"), F.col("f"), F.col("s")).alias("n"), T.wrap(F.col("t"), F.col("f"), F.col("s"), F.col("w")).alias("l")).collect()
    for r in made:
        _, t, f, s, w = rows[r.i]
        assert r.n == pytest.approx(fonts.text_width(f, t, s)) and r.l == L.wrap(t, f, s, w), rows[r.i]


def scattered(seed: int, n: int = 150) -> list[tuple]:
    import random

    r = random.Random(seed)
    return [("d", 0, k, 65, r.choice(["a", "B", " ", "é", "", " "]), x, y - 8, x + 5, y + 2, x, y, "Font", s) for k in range(n) for x, y, s in [(r.randrange(60) * 4.0, r.randrange(40) * 2.5, r.choice([8.0, 12.0]))]]


@pytest.mark.parametrize("seed", range(3))
def test_grouping_is_the_same_in_both_forms(spark, seed):
    rows = scattered(seed)
    df = spark.createDataFrame(rows, tables.SCHEMAS["glyphs"])
    blocks = L.blocks(L.lines([L.Glyph(r[3], r[4], *r[5:11], r[12], r[2]) for r in rows]))
    flat = [(b, k, line) for b, block in enumerate(blocks) for k, line in enumerate(block)]
    assert [(r.block, r.line, r.text) for r in grouping.lines(df).orderBy("block", "line").collect()] == [(b, k, L.line_text(x)) for b, k, x in flat]
    words = [(b, k, n, "".join(g.text for g in w), L.bbox(w)) for b, k, x in flat for n, w in enumerate(L.line_words(x))]
    assert [(r.block, r.line, r.word_no, r.word, (r.x0, r.y0, r.x1, r.y1)) for r in grouping.words(df).orderBy("block", "line", "word_no").collect()] == words
    spans = [(b, k, n, "".join(g.text for g in s), s[0].size) for b, k, x in flat for n, s in enumerate(L.line_spans(x))]
    assert [(r.block, r.line, r.span, r.text, r["size"]) for r in grouping.spans(df).orderBy("block", "line", "span").collect()] == spans
    assert grouping.text(df).first().text == L.page_text(blocks)
    nested = grouping.page_dict(df).first().blocks
    assert [len(b.lines) for b in nested] == [len(b) for b in blocks]


def test_grouping_shuffles_once(spark):
    df = spark.createDataFrame(scattered(1), tables.SCHEMAS["glyphs"])
    plan = grouping.words(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


COMMANDS = "doc_id string, page int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, text string, fontname string, fontsize double"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", 0, 0, "text", 72.0, 72.0, None, None, "Hello there", "helv", 12.0), ("a", 2, 0, "box", 0.0, 200.0, 400.0, 260.0, "CENTERED BOLD", "Helvetica-Bold", 28.0), ("b", 0, 0, "text", 10.0, 50.0, None, None, "Other", "cour", 10.0)]
    return authoring.write_documents(spark.createDataFrame(rows, COMMANDS), 400, 600).persist()


def test_corpus(spark, files):
    c = read_pdf(files)
    assert {r.doc_id: r.page_count for r in c.documents.collect()} == {"a": 3, "b": 1}
    assert [(r.doc_id, r.page, r.text) for r in c.text.orderBy("doc_id", "page").collect()] == [("a", 0, "Hello there"), ("a", 1, ""), ("a", 2, "CENTERED BOLD"), ("b", 0, "Other")]
    assert c.page(-1).count() == 2 and c.page(1).count() == 1
    assert c.links.count() == c.toc.count() == c.annots.count() == c.images.count() == c.image_data.count() == c.destinations.count() == 0
    with pytest.raises(AttributeError):
        c.nothing  # noqa: B018
    with pytest.raises(ValueError):
        grouping.get_text(c, "html")
    c.create_views("t_")
    assert spark.sql("SELECT count(*) FROM t_words").first()[0] == 5
    words = {(r.doc_id, r.word): r for r in c.words.collect()}
    single = api.from_bytes(bytes(files.where("doc_id = 'a'").first().content))
    for w in single[2].get_text("words"):
        r = words["a", w[4]]
        assert (r.x0, r.y0, r.x1, r.y1) == pytest.approx(w[:4])


def test_stamp(spark, files):
    edits = spark.createDataFrame([("a", 0, "STAMP", 300.0), ("b", 9, "nowhere", 300.0)], "doc_id string, page int, text string, y0 double")
    out = {r.doc_id: r for r in authoring.stamp(files, edits).collect()}
    assert out["a"].error is None and "STAMP" in api.from_bytes(bytes(out["a"].content))[0].get_text()
    assert out["b"].error.startswith("PageNotFound") and bytes(out["b"].content) == bytes(files.where("doc_id = 'b'").first().content)


def test_files_source_and_stream(spark, files, tmp_path):
    saved = authoring.save_files(files, str(tmp_path / "pdf")).collect()
    assert len(saved) == 2
    (tmp_path / "pdf" / "bad.pdf").write_bytes(b"nothing")
    c = read_pdf(str(tmp_path / "pdf" / "*.pdf"), spark)
    assert sorted(r.error_class or "" for r in c.documents.collect()) == ["", "", "FileData"] and c.words.count() == 5
    from folia.sources.datasource import register

    register(spark)
    source = spark.read.format("pdf").option("table", "pages").load(str(tmp_path / "pdf"))
    assert source.count() == 4
    one = spark.read.format("pdf").option("table", "documents").load(str(tmp_path / "pdf" / "*.pdf"))
    assert one.where(F.col("doc_id") == str(tmp_path / "pdf" / "b.pdf")).first().page_count == 1
    files.createOrReplaceTempView("pdf_files_view")
    assert spark.sql("SELECT count(*) FROM pdf_files_view f, LATERAL pdf_glyphs(f.doc_id, f.content)").first()[0] == 29
    from folia.streaming import ingest

    q = ingest.ingest(ingest.stream_files(spark, str(tmp_path / "pdf")), str(tmp_path / "out"), str(tmp_path / "check"), ("documents", "glyphs"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out" / "documents")).count() == 3 and spark.read.parquet(str(tmp_path / "out" / "glyphs")).count() == 29


def test_lookups(spark):
    nodes = spark.createDataFrame([("d", "r", None, 1), ("d", "a", "r", None), ("d", "b", "a", None), ("d", "c", "a", 5), ("d", "x", "y", None)], "doc_id string, node string, parent string, v int")
    assert {r.node: r.v for r in navigation.inherited(nodes, ["v"]).collect()} == {"r": 1, "a": 1, "b": 1, "c": 5, "x": None}
    defs = spark.createDataFrame([("d", 1, 10, "old"), ("d", 1, 20, "new"), ("d", 2, 5, "one")], "doc_id string, obj_num int, at int, v string")
    assert {r.obj_num: r.v for r in navigation.latest(defs, "at").collect()} == {1: "new", 2: "one"}


def test_empty_corpus(spark):
    c = Corpus(spark.createDataFrame([], "doc_id string, content binary"))
    assert c.words.count() == c.text.count() == c.documents.count() == 0


def test_rows_of_late_types_are_dealt_out(spark):
    """A file for each row, also where ids are null or repeat, and not all in one task."""
    from folia.plans import corpora

    files = corpora.late_type(spark.createDataFrame([("a", 3), ("a", 2), (None, 0), ("b", None)] * 8, "doc_id string, filler int").coalesce(1))
    found = Corpus(files).documents.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(str(r.doc_id) for r in found) == ["None"] * 8 + ["a"] * 16 + ["b"] * 8
    assert {(r.page_count, r.error_class) for r in found} == {(1, None)} and len({r.part for r in found}) > 1


def test_pages_by_index_in_one_parse(spark):
    """Pages by index from either end, none beyond; documents are not parsed again to be counted and joined."""
    from folia.plans import corpora

    rows = spark.createDataFrame([(d, k, 100 + k, 200, 0) for d, n in (("a", 1), ("b", 3)) for k in range(n)], "doc_id string, pos int, w int, h int, turn int")
    c = Corpus(corpora.boxed(rows))
    found = {k: sorted((r.doc_id, r.page, r.mediabox.x1) for r in c.page(k).collect()) for k in (0, 2, 3, -1, -3, -4)}
    assert found == {0: [("a", 0, 100.0), ("b", 0, 100.0)], 2: [("b", 2, 102.0)], 3: [], -1: [("a", 0, 100.0), ("b", 2, 102.0)], -3: [("b", 0, 100.0)], -4: []}
    assert "Join" not in c.page(-1)._jdf.queryExecution().executedPlan().toString()
