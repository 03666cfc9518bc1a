"""Points, matrices, rectangles and quads as struct Columns.

point(x, y); matrix(a .. f) with x' = a x + c y + e and y' = b x + d y + f; rect(x0, y0, x1, y1); irect, a rect of whole numbers;
quad(ul, ur, ll, lr). Every function is a Column expression, so it takes part in code generation and pushdown.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
MATRIX = ("a", "b", "c", "d", "e", "f")
CORNERS = ("ul", "ur", "ll", "lr")
INFINITY = float("inf")


def _num(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)).cast("double")


def _made(names, values) -> Column:
    """A struct that remembers its fields, so that what is built on it needs no struct around them."""
    fields = dict(zip(names, values))
    out = F.struct(*[v.alias(n) for n, v in fields.items()])
    out.__dict__["_folia"] = fields
    return out


def _at(value: Column, name: str) -> Column:
    """A field of a struct, as the expression it was made of where that is known."""
    known = value.__dict__.get("_folia", {})
    return known[name] if name in known else value[name]


# points


def point(x=0.0, y=0.0) -> Column:
    return _made("xy", (_num(x), _num(y)))


def length(p: Column) -> Column:
    return F.sqrt(_at(p, "x") * _at(p, "x") + _at(p, "y") * _at(p, "y"))


def unit(p: Column) -> Column:
    """The direction of p; the zero vector stays zero."""
    n = length(p)
    return _made("xy", (F.when(n == 0, 0.0).otherwise(_at(p, "x") / n), F.when(n == 0, 0.0).otherwise(_at(p, "y") / n)))


def abs_unit(p: Column) -> Column:
    return unit(point(F.abs(_at(p, "x")), F.abs(_at(p, "y"))))


def distance(p: Column, q: Column) -> Column:
    return length(point(_at(p, "x") - _at(q, "x"), _at(p, "y") - _at(q, "y")))


def add(p: Column, q: Column) -> Column:
    return point(_at(p, "x") + _at(q, "x"), _at(p, "y") + _at(q, "y"))


def subtract(p: Column, q: Column) -> Column:
    return point(_at(p, "x") - _at(q, "x"), _at(p, "y") - _at(q, "y"))


def multiply(p: Column, q: Column) -> Column:
    return point(_at(p, "x") * _at(q, "x"), _at(p, "y") * _at(q, "y"))


def divide(p: Column, q: Column) -> Column:
    return point(_at(p, "x") / _at(q, "x"), _at(p, "y") / _at(q, "y"))


def shift(p: Column, value) -> Column:
    """p plus a number, which counts as (value, 0)."""
    return point(_at(p, "x") + _num(value), _at(p, "y"))


def scale(p: Column, value) -> Column:
    return point(_at(p, "x") * _num(value), _at(p, "y") * _num(value))


def transform_point(p: Column, m: Column) -> Column:
    return point(_at(p, "x") * _at(m, "a") + _at(p, "y") * _at(m, "c") + _at(m, "e"), _at(p, "x") * _at(m, "b") + _at(p, "y") * _at(m, "d") + _at(m, "f"))


def point_array(p: Column) -> Column:
    return F.array(_at(p, "x"), _at(p, "y"))


# matrices


def matrix(a=0.0, b=0.0, c=0.0, d=0.0, e=0.0, f=0.0) -> Column:
    """Without arguments the zero matrix."""
    return _made(MATRIX, map(_num, (a, b, c, d, e, f)))


def identity() -> Column:
    return matrix(1, 0, 0, 1)


def translation(x, y) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def scaling(x, y) -> Column:
    return matrix(x, 0, 0, y)


def rotation(degrees) -> Column:
    angle = F.radians(_num(degrees))
    return matrix(F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle))


def shearing(h, v) -> Column:
    return matrix(1, v, h, 1)


def determinant(m: Column) -> Column:
    return _at(m, "a") * _at(m, "d") - _at(m, "b") * _at(m, "c")


def is_identity(m: Column) -> Column:
    return functools.reduce(lambda p, q: p & q, [_at(m, k) == (1.0 if k in "ad" else 0.0) for k in MATRIX])


def is_invertible(m: Column) -> Column:
    return determinant(m) != 0


def concat(m: Column, n: Column) -> Column:
    """The matrix that does m, then n."""
    return matrix(
        _at(m, "a") * _at(n, "a") + _at(m, "b") * _at(n, "c"),
        _at(m, "a") * _at(n, "b") + _at(m, "b") * _at(n, "d"),
        _at(m, "c") * _at(n, "a") + _at(m, "d") * _at(n, "c"),
        _at(m, "c") * _at(n, "b") + _at(m, "d") * _at(n, "d"),
        _at(m, "e") * _at(n, "a") + _at(m, "f") * _at(n, "c") + _at(n, "e"),
        _at(m, "e") * _at(n, "b") + _at(m, "f") * _at(n, "d") + _at(n, "f"),
    )


def try_inverse(m: Column) -> Column:
    """The inverse, null where there is none."""
    det = determinant(m)
    inverse = matrix(_at(m, "d") / det, -_at(m, "b") / det, -_at(m, "c") / det, _at(m, "a") / det, (_at(m, "c") * _at(m, "f") - _at(m, "d") * _at(m, "e")) / det, (_at(m, "b") * _at(m, "e") - _at(m, "a") * _at(m, "f")) / det)
    return F.when(det != 0, inverse)


def inverse(m: Column) -> Column:
    """The inverse; a singular matrix is an error."""
    empty = F.raise_error(F.lit("the matrix has no inverse")).cast("struct<a:double,b:double,c:double,d:double,e:double,f:double>")
    return F.when(determinant(m) == 0, empty).otherwise(try_inverse(m))


def pre_translate(m: Column, x, y) -> Column:
    return concat(translation(x, y), m)


def pre_scale(m: Column, x, y) -> Column:
    return concat(scaling(x, y), m)


def pre_shear(m: Column, h, v) -> Column:
    return concat(shearing(h, v), m)


def pre_rotate(m: Column, degrees) -> Column:
    """Exact at whole quarter turns."""
    turn = F.pmod(_num(degrees), F.lit(360.0))
    angle = F.radians(turn)
    sin, cos = F.sin(angle), F.cos(angle)
    for at, s, c in ((0.0, 0.0, 1.0), (90.0, 1.0, 0.0), (180.0, 0.0, -1.0), (270.0, -1.0, 0.0)):
        sin, cos = F.when(turn == at, s).otherwise(sin), F.when(turn == at, c).otherwise(cos)
    return concat(matrix(cos, sin, -sin, cos), m)


def matrix_array(m: Column) -> Column:
    return F.array(*[_at(m, k) for k in MATRIX])


# rectangles


def rect(x0=0.0, y0=0.0, x1=0.0, y1=0.0) -> Column:
    return _made(BOX, map(_num, (x0, y0, x1, y1)))


def irect(r: Column) -> Column:
    """r cut to whole numbers, toward zero."""
    return _made(BOX, [_at(r, k).cast("long") for k in BOX])


def irect_rect(r: Column) -> Column:
    return rect(*[_at(r, k) for k in BOX])


def width(r: Column) -> Column:
    return F.greatest(F.lit(0.0), _at(r, "x1") - _at(r, "x0"))


def height(r: Column) -> Column:
    return F.greatest(F.lit(0.0), _at(r, "y1") - _at(r, "y0"))


def irect_width(r: Column) -> Column:
    """Negative where the corners are."""
    return _at(r, "x1") - _at(r, "x0")


def irect_height(r: Column) -> Column:
    return _at(r, "y1") - _at(r, "y0")


def area(r: Column) -> Column:
    """Signed."""
    return (_at(r, "x1") - _at(r, "x0")) * (_at(r, "y1") - _at(r, "y0"))


def is_empty(r: Column) -> Column:
    return (_at(r, "x0") >= _at(r, "x1")) | (_at(r, "y0") >= _at(r, "y1"))


def is_valid(r: Column) -> Column:
    return (_at(r, "x0") <= _at(r, "x1")) & (_at(r, "y0") <= _at(r, "y1"))


def is_infinite(r: Column) -> Column:
    low, high = F.lit(-INFINITY), F.lit(INFINITY)
    return (_at(r, "x0") == low) | (_at(r, "y0") == low) | (_at(r, "x1") == high) | (_at(r, "y1") == high)


def top_left(r: Column) -> Column:
    return point(_at(r, "x0"), _at(r, "y0"))


def top_right(r: Column) -> Column:
    return point(_at(r, "x1"), _at(r, "y0"))


def bottom_left(r: Column) -> Column:
    return point(_at(r, "x0"), _at(r, "y1"))


def bottom_right(r: Column) -> Column:
    return point(_at(r, "x1"), _at(r, "y1"))


def normalize(r: Column) -> Column:
    return rect(F.least(_at(r, "x0"), _at(r, "x1")), F.least(_at(r, "y0"), _at(r, "y1")), F.greatest(_at(r, "x0"), _at(r, "x1")), F.greatest(_at(r, "y0"), _at(r, "y1")))


def round_out(r: Column) -> Column:
    """The whole-number rectangle around r."""
    return _made(BOX, (F.floor(_at(r, "x0")), F.floor(_at(r, "y0")), F.ceil(_at(r, "x1")), F.ceil(_at(r, "y1"))))


def contains_point(r: Column, p: Column) -> Column:
    """Borders count."""
    return (_at(p, "x") >= _at(r, "x0")) & (_at(p, "x") <= _at(r, "x1")) & (_at(p, "y") >= _at(r, "y0")) & (_at(p, "y") <= _at(r, "y1"))


def contains_xy(r: Column, xy: Column) -> Column:
    return contains_point(r, point(F.element_at(xy, 1), F.element_at(xy, 2)))


def contains_rect(r: Column, s: Column) -> Column:
    """An empty rectangle lies in every one."""
    return is_empty(s) | ((_at(s, "x0") >= _at(r, "x0")) & (_at(s, "y0") >= _at(r, "y0")) & (_at(s, "x1") <= _at(r, "x1")) & (_at(s, "y1") <= _at(r, "y1")))


def intersection(r: Column, s: Column) -> Column:
    """Corners may be reversed where the two don't meet."""
    return rect(F.greatest(_at(r, "x0"), _at(s, "x0")), F.greatest(_at(r, "y0"), _at(s, "y0")), F.least(_at(r, "x1"), _at(s, "x1")), F.least(_at(r, "y1"), _at(s, "y1")))


def intersects(r: Column, s: Column) -> Column:
    """Touching is not enough."""
    return ~is_empty(intersection(r, s))


def union(r: Column, s: Column) -> Column:
    """An empty rectangle adds nothing."""
    both = rect(F.least(_at(r, "x0"), _at(s, "x0")), F.least(_at(r, "y0"), _at(s, "y0")), F.greatest(_at(r, "x1"), _at(s, "x1")), F.greatest(_at(r, "y1"), _at(s, "y1")))
    return F.when(is_empty(s), r).when(is_empty(r), s).otherwise(both)


def include_point(r: Column, p: Column) -> Column:
    """r grown to p; an empty one becomes the point."""
    grown = rect(F.least(_at(r, "x0"), _at(p, "x")), F.least(_at(r, "y0"), _at(p, "y")), F.greatest(_at(r, "x1"), _at(p, "x")), F.greatest(_at(r, "y1"), _at(p, "y")))
    return F.when(is_empty(r), rect(_at(p, "x"), _at(p, "y"), _at(p, "x"), _at(p, "y"))).otherwise(grown)


def include_points(r: Column, points: Column) -> Column:
    """include_point over an array, one after the other: points that leave r empty are forgotten."""
    return F.aggregate(points, r, lambda acc, p: include_point(acc, p))


def _around(corners) -> Column:
    xs, ys = [_at(p, "x") for p in corners], [_at(p, "y") for p in corners]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def transform_rect(r: Column, m: Column) -> Column:
    """The rectangle around the four moved corners."""
    return _around([transform_point(p(r), m) for p in (top_left, top_right, bottom_left, bottom_right)])


def flip(r: Column, page_height) -> Column:
    """Between y up from the bottom and y down from the top of a page."""
    h = _num(page_height)
    return rect(_at(r, "x0"), h - _at(r, "y1"), _at(r, "x1"), h - _at(r, "y0"))


def rect_array(r: Column) -> Column:
    return F.array(*[_at(r, k) for k in BOX])


# aggregates


def bbox(r: Column) -> Column:
    """Aggregate: the rectangle around all rectangles that are not empty; null without any."""
    own = [F.when(~is_empty(r), _at(r, k)) for k in BOX]
    return F.struct(F.min(own[0]).alias("x0"), F.min(own[1]).alias("y0"), F.max(own[2]).alias("x1"), F.max(own[3]).alias("y1"))


def common(r: Column) -> Column:
    """Aggregate: the intersection of all rectangles."""
    return F.struct(F.max(_at(r, "x0")).alias("x0"), F.max(_at(r, "y0")).alias("y0"), F.min(_at(r, "x1")).alias("x1"), F.min(_at(r, "y1")).alias("y1"))


def points_bbox(p: Column) -> Column:
    """Aggregate: the rectangle around all points."""
    return F.struct(F.min(_at(p, "x")).alias("x0"), F.min(_at(p, "y")).alias("y0"), F.max(_at(p, "x")).alias("x1"), F.max(_at(p, "y")).alias("y1"))


# quads


def quad(ul: Column, ur: Column, ll: Column, lr: Column) -> Column:
    return _made(CORNERS, (ul, ur, ll, lr))


def rect_quad(r: Column) -> Column:
    return quad(top_left(r), top_right(r), bottom_left(r), bottom_right(r))


def quad_rect(q: Column) -> Column:
    return _around([_at(q, k) for k in CORNERS])


def transform_quad(q: Column, m: Column) -> Column:
    return quad(*[transform_point(_at(q, k), m) for k in CORNERS])


def is_rectangular(q: Column) -> Column:
    return (_at(_at(q, "ul"), "y") == _at(_at(q, "ur"), "y")) & (_at(_at(q, "ll"), "y") == _at(_at(q, "lr"), "y")) & (_at(_at(q, "ul"), "x") == _at(_at(q, "ll"), "x")) & (_at(_at(q, "ur"), "x") == _at(_at(q, "lr"), "x"))


def is_empty_quad(q: Column) -> Column:
    return is_empty(quad_rect(q))


def label(kind: str, *values: Column) -> Column:
    """A readable form: whole numbers without decimals."""
    shown = [F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string")) for v in values]
    return F.concat(F.lit(f"{kind}("), F.concat_ws(", ", *shown), F.lit(")"))
