"""Queries of geometry over numeric columns, with SQL. Doubles are compared as whole thousandths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import geometry as G
from folia.operators import navigation


def k(value, by: int = 1000):
    """Whole multiples of 1 / by, by the same arithmetic as SQL_K."""
    return F.floor(value * F.lit(float(by)) + F.lit(0.5)).cast("long")


def sql_k(value: str, by: int = 1000) -> str:
    return f"CAST(floor(({value}) * {by}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def _select(names: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {n}" for n, v in names.items())


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    cols = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys, *[F.col(c).cast("double").alias(n) for n, c in cols.items()])


ITEMS = "items AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t FROM lineitem)"
KEYS = "l_orderkey, l_linenumber"


def geom_points(spark, sf_dir):
    i = _items(spark, sf_dir)
    a, b = G.point("q", F.col("d") * -100), G.point("t", "q")
    u, v = G.unit(a), G.abs_unit(a)
    made = {"len": G.length(a), "ux": u["x"], "uy": u["y"], "ax": v["x"], "ay": v["y"], "dist": G.distance(a, b), "sx": G.add(a, b)["x"], "sy": G.subtract(a, b)["y"], "mx": G.multiply(a, b)["x"], "dy": G.divide(a, b)["y"], "hx": G.shift(a, 3)["x"], "hy": G.shift(a, 3)["y"], "ky": G.scale(a, 2.5)["y"]}
    return i.select("l_orderkey", "l_linenumber", *[k(c).alias(n) for n, c in made.items()])


_LEN = "sqrt(q * q + y * y)"
GEOM_POINTS = f"WITH {ITEMS}, p AS (SELECT *, d * -100 AS y FROM items) SELECT {KEYS}, " + _select({n: sql_k(v) for n, v in {"len": _LEN, "ux": f"q / {_LEN}", "uy": f"y / {_LEN}", "ax": f"q / {_LEN}", "ay": f"abs(y) / {_LEN}", "dist": "sqrt((q - t) * (q - t) + (y - q) * (y - q))", "sx": "q + t", "sy": "y - q", "mx": "q * t", "dy": "y / q", "hx": "q + 3", "hy": "y", "ky": "y * 2.5::DOUBLE"}.items()}) + " FROM p"


def geom_matrices(spark, sf_dir):
    i = _items(spark, sf_dir)
    m = G.matrix("q", "d", "t", 2, 5, 6)
    n = G.matrix(1, "t", "d", 3, "q", 1)
    c, v = G.concat(m, n), G.inverse(m)
    r = G.pre_rotate(G.translation("q", 1), F.col("l_linenumber") * 90)
    s = G.pre_shear(G.pre_scale(G.pre_translate(m, 3, 4), 2, 0.5), 1, 2)
    rot = G.transform_point(G.point("q", "d"), G.rotation(30))
    made = {"det": G.determinant(m), **{f"c{x}": c[x] for x in G.MATRIX}, "va": v["a"], "vd": v["d"], "ve": v["e"], "ra": r["a"], "rb": r["b"], "re": r["e"], "sa": s["a"], "sb": s["b"], "sd": s["d"], "se": s["e"], "rx": rot["x"], "ry": rot["y"]}
    flags = [G.is_identity(G.concat(m, G.identity())).alias("same"), G.is_invertible(m).alias("can"), G.is_identity(G.identity()).alias("one")]
    return i.select("l_orderkey", "l_linenumber", *[k(x).alias(n) for n, x in made.items()], *flags)


_DET = "(q * 2 - d * t)"
_P = {"a": "q", "b": "d", "c": "t", "d": "2", "e": "3 * q + 4 * t + 5", "f": "3 * d + 4 * 2 + 6"}
GEOM_MATRICES = f"WITH {ITEMS} SELECT {KEYS}, " + _select({
    **{n: sql_k(v) for n, v in {
        "det": _DET, "ca": "q * 1 + d * d", "cb": "q * t + d * 3", "cc": "t * 1 + 2 * d", "cd": "t * t + 2 * 3", "ce": "5 * 1 + 6 * d + q", "cf": "5 * t + 6 * 3 + 1",
        "va": f"2 / {_DET}", "vd": f"q / {_DET}", "ve": f"(t * 6 - 2 * 5) / {_DET}",
        "ra": "CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END", "rb": "CASE l_linenumber % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END", "re": "q",
        "sa": "2 * q + 2 * (0.5::DOUBLE * t)", "sb": "2 * d + 2 * (0.5::DOUBLE * 2)", "sd": "1 * (2 * d) + 0.5::DOUBLE * 2", "se": _P["e"],
        "rx": "q * cos(radians(30::DOUBLE)) + d * -sin(radians(30::DOUBLE))", "ry": "q * sin(radians(30::DOUBLE)) + d * cos(radians(30::DOUBLE))"}.items()},
    "same": "q = 1 AND d = 0 AND t = 0 AND 2 = 1", "can": f"{_DET} <> 0", "one": "true"}) + " FROM items"


def _boxes(spark, sf_dir):
    """Rectangles over plain columns: a struct of attributes costs nothing where it is used."""
    flat = _items(spark, sf_dir).selectExpr("*", "q AS a0", "d * 100 AS a1", "t * 500 AS a2", "q * 1.5D AS a3", "d * 200 AS py")
    n = G.normalize(G.rect("a0", "a1", "a2", "a3"))
    flat = flat.select("*", *[n[c].alias(c) for c in G.BOX])
    return flat.select("*", G.rect("a0", "a1", "a2", "a3").alias("a"), G.rect("x0", "y0", "x1", "y1").alias("r"), G.rect(10, 5, 30, 40).alias("s"), G.point("q", "py").alias("pt"))


BOXES = ITEMS + ", raw AS (SELECT *, q AS a0, d * 100 AS a1, t * 500 AS a2, q * 1.5::DOUBLE AS a3 FROM items), boxes AS (SELECT *, least(a0, a2) AS x0, least(a1, a3) AS y0, greatest(a0, a2) AS x1, greatest(a1, a3) AS y1, q AS px, d * 200 AS py FROM raw)"


def geom_predicates(spark, sf_dir):
    a, r, s, pt = (F.col(c) for c in ("a", "r", "s", "pt"))
    made = {"has": G.contains_point(r, pt), "has_xy": G.contains_xy(r, F.array("q", F.col("d") * 200)), "inside": G.contains_rect(s, a), "inside_n": G.contains_rect(s, r), "meets": G.intersects(r, s), "empty": G.is_empty(a), "valid": G.is_valid(a), "infinite": G.is_infinite(G.rect(-float("inf"), 0, "q", 1)), "finite": G.is_infinite(r), "eq": r == s, "quad": G.is_rectangular(G.rect_quad(r)), "quad_empty": G.is_empty_quad(G.rect_quad(r))}
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in made.items()])


GEOM_PREDICATES = f"WITH {BOXES} SELECT {KEYS}, " + _select({
    "has": "px >= x0 AND px <= x1 AND py >= y0 AND py <= y1", "has_xy": "px >= x0 AND px <= x1 AND py >= y0 AND py <= y1",
    "inside": "(a0 >= a2 OR a1 >= a3) OR (a0 >= 10 AND a1 >= 5 AND a2 <= 30 AND a3 <= 40)", "inside_n": "(x0 >= x1 OR y0 >= y1) OR (x0 >= 10 AND y0 >= 5 AND x1 <= 30 AND y1 <= 40)",
    "meets": "NOT (greatest(x0, 10) >= least(x1, 30) OR greatest(y0, 5) >= least(y1, 40))", "empty": "a0 >= a2 OR a1 >= a3", "valid": "a0 <= a2 AND a1 <= a3",
    "infinite": "true", "finite": "false", "eq": "x0 = 10 AND y0 = 5 AND x1 = 30 AND y1 = 40", "quad": "true", "quad_empty": "x0 >= x1 OR y0 >= y1"}) + " FROM boxes"


def geom_rects(spark, sf_dir):
    a, r, s, pt = (F.col(c) for c in ("a", "r", "s", "pt"))
    u, n, o, i, g = G.union(a, s), G.intersection(r, s), G.round_out(r), G.irect(G.rect(F.col("q") * -0.7, "d", F.col("q") * 0.7, "t")), G.include_point(a, pt)
    m, f, q = G.transform_rect(r, G.concat(G.scaling(2, -3), G.translation("q", 1))), G.flip(r, 800), G.quad_rect(G.transform_quad(G.rect_quad(r), G.translation(1, 2)))
    made = {"w": G.width(a), "h": G.height(a), "area": G.area(a), **{f"u{c}": u[c] for c in G.BOX}, **{f"n{c}": n[c] for c in G.BOX}, **{f"m{c}": m[c] for c in G.BOX}, "f0": f["y0"], "f1": f["y1"], "g0": g["x0"], "g1": g["y1"], "q0": q["x0"], "q1": q["y1"], "tr": G.top_right(r)["x"], "bl": G.bottom_left(r)["y"], "tl": G.top_left(r)["x"], "br": G.bottom_right(r)["y"]}
    whole = {**{f"o{c}": o[c] for c in G.BOX}, "ix0": i["x0"], "ix1": i["x1"], "iw": G.irect_width(i), "ih": G.irect_height(i)}
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", *[k(c).alias(x) for x, c in made.items()], *[c.cast("long").alias(x) for x, c in whole.items()])


_E = "(a0 >= a2 OR a1 >= a3)"
GEOM_RECTS = f"WITH {BOXES} SELECT {KEYS}, " + _select({n: sql_k(v) for n, v in {
    "w": "greatest(0, a2 - a0)", "h": "greatest(0, a3 - a1)", "area": "(a2 - a0) * (a3 - a1)",
    "ux0": f"CASE WHEN {_E} THEN 10 ELSE least(a0, 10) END", "uy0": f"CASE WHEN {_E} THEN 5 ELSE least(a1, 5) END", "ux1": f"CASE WHEN {_E} THEN 30 ELSE greatest(a2, 30) END", "uy1": f"CASE WHEN {_E} THEN 40 ELSE greatest(a3, 40) END",
    "nx0": "greatest(x0, 10)", "ny0": "greatest(y0, 5)", "nx1": "least(x1, 30)", "ny1": "least(y1, 40)",
    "mx0": "x0 * 2 + q", "mx1": "x1 * 2 + q", "my0": "y1 * -3 + 1", "my1": "y0 * -3 + 1", "f0": "800 - y1", "f1": "800 - y0",
    "g0": f"CASE WHEN {_E} THEN px ELSE least(a0, px) END", "g1": f"CASE WHEN {_E} THEN py ELSE greatest(a3, py) END", "q0": "x0 + 1", "q1": "y1 + 2", "tr": "x1", "bl": "y1", "tl": "x0", "br": "y1"}.items()}
    | {"ox0": "CAST(floor(x0) AS BIGINT)", "oy0": "CAST(floor(y0) AS BIGINT)", "ox1": "CAST(ceil(x1) AS BIGINT)", "oy1": "CAST(ceil(y1) AS BIGINT)", "ix0": "CAST(trunc(q * -0.7::DOUBLE) AS BIGINT)", "ix1": "CAST(trunc(q * 0.7::DOUBLE) AS BIGINT)", "iw": "CAST(trunc(q * 0.7::DOUBLE) AS BIGINT) - CAST(trunc(q * -0.7::DOUBLE) AS BIGINT)", "ih": "CAST(trunc(t) AS BIGINT) - CAST(trunc(d) AS BIGINT)"}) + " FROM boxes"


def geom_bbox(spark, sf_dir):
    g = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(G.bbox(F.col("r")).alias("b"), G.common(F.col("r")).alias("c"), G.points_bbox(F.col("pt")).alias("p"), F.count("*").alias("n"))
    return g.select("l_orderkey", "n", *[k(F.col(f"{x}.{c}")).alias(f"{x}{c}") for x in "bcp" for c in G.BOX])


_OK = "FILTER (WHERE NOT (x0 >= x1 OR y0 >= y1))"
GEOM_BBOX = f"WITH {BOXES} SELECT l_orderkey, count(*) AS n, " + _select({n: sql_k(v) for n, v in {
    "bx0": f"min(x0) {_OK}", "by0": f"min(y0) {_OK}", "bx1": f"max(x1) {_OK}", "by1": f"max(y1) {_OK}", "cx0": "max(x0)", "cy0": "max(y0)", "cx1": "min(x1)", "cy1": "min(y1)", "px0": "min(px)", "py0": "min(py)", "px1": "max(px)", "py1": "max(py)"}.items()}) + " FROM boxes GROUP BY 1"


def geom_include_points(spark, sf_dir):
    """The fold over a line of points: what starts empty is replaced by the point as long as it stays empty."""
    pts = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "q", "d"))), lambda x: F.struct(x["q"].alias("x"), (x["d"] * 100).alias("y"))).alias("pts"))
    out = pts.withColumn("r", G.include_points(G.rect(), F.col("pts")))
    return out.select("l_orderkey", *[k(F.col(f"r.{c}")).alias(c) for c in G.BOX])


GEOM_INCLUDE_POINTS = f"""
WITH RECURSIVE {ITEMS}, p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q, d) AS i, q AS x, d * 100 AS y FROM items),
f AS (
  SELECT l_orderkey, 0::BIGINT AS i, 0::DOUBLE AS x0, 0::DOUBLE AS y0, 0::DOUBLE AS x1, 0::DOUBLE AS y1 FROM p WHERE i = 1
  UNION ALL
  SELECT f.l_orderkey, p.i, CASE WHEN e THEN x ELSE least(x0, x) END, CASE WHEN e THEN y ELSE least(y0, y) END, CASE WHEN e THEN x ELSE greatest(x1, x) END, CASE WHEN e THEN y ELSE greatest(y1, y) END
  FROM (SELECT *, x0 >= x1 OR y0 >= y1 AS e FROM f) f JOIN p ON p.l_orderkey = f.l_orderkey AND p.i = f.i + 1)
SELECT l_orderkey, {_select({c: sql_k(c) for c in ("x0", "y0", "x1", "y1")})} FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY i DESC) = 1
"""


def spatial_join(spark, sf_dir):
    """Rectangles of parts that contain points of suppliers with the same key: an equi join with a residual predicate."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 25).cast("int").alias("cell"), G.rect(F.lit(0), F.lit(0), F.col("p_size") * 20, F.col("p_retailprice")).alias("r"))
    spot = G.rect(F.col("p")["x"], F.col("p")["y"], F.col("p")["x"], F.col("p")["y"])
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").cast("int").alias("cell"), G.point(F.col("s_suppkey") % 997, "s_acctbal").alias("p"))
    found = navigation.overlapping(part, supplier.withColumn("spot", spot), lambda l, r: G.contains_point(l("r"), r("p")), ["cell"], ("r", "spot"), 250.0)  # noqa: E741
    return found.select("p_partkey", "s_suppkey", "cell")


SPATIAL_JOIN = """
SELECT p_partkey, s_suppkey, s_nationkey AS cell FROM part JOIN supplier ON p_partkey % 25 = s_nationkey
WHERE s_suppkey % 997 BETWEEN 0 AND p_size * 20 AND s_acctbal BETWEEN 0 AND p_retailprice
"""

QUERIES = {f.__name__: f for f in (geom_points, geom_matrices, geom_predicates, geom_rects, geom_bbox, geom_include_points, spatial_join)}
ORACLES = {"geom_points": GEOM_POINTS, "geom_matrices": GEOM_MATRICES, "geom_predicates": GEOM_PREDICATES, "geom_rects": GEOM_RECTS, "geom_bbox": GEOM_BBOX, "geom_include_points": GEOM_INCLUDE_POINTS, "spatial_join": SPATIAL_JOIN}
