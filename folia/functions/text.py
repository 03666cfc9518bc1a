"""Measuring, wrapping and placing text as Column expressions, and the strings of content operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.pdf.fonts import ALIASES, COURIER, HELVETICA, HELVETICA_BOLD, OTHER


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _constant(values) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def standard_name(name: Column) -> Column:
    """The font that a short name stands for; other names stay."""
    out = name
    for short, base in ALIASES.items():
        out = F.when(F.lower(name) == short, base).otherwise(out)
    return out


def is_bold(name: Column) -> Column:
    return F.contains(standard_name(name), F.lit("Bold"))


def _units(text: Column, table: Column, other: int) -> Column:
    """The summed widths of the characters in thousandths."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.coalesce(F.get(table, F.when(F.ascii(c) >= 32, F.ascii(c) - 32)), F.lit(other))))


def text_units(text: Column, font: Column) -> Column:
    return _base_units(text, standard_name(font))


def _base_units(text: Column, base: Column) -> Column:
    """text_units of a font by its full name."""
    fixed = F.length(text) * COURIER
    return F.when(base.startswith("Courier"), fixed).when(base.startswith("Helvetica-Bold"), _units(text, _constant(HELVETICA_BOLD), OTHER)).otherwise(_units(text, _constant(HELVETICA), OTHER))


def text_width(text: Column, font: Column, size: Column) -> Column:
    """The width of a text in a standard font, in points."""
    return text_units(text, font) / F.lit(1000.0) * size


def char_width(code: Column, font: Column) -> Column:
    return text_units(F.char(code), font)


def wrap(text: Column, font: Column, size: Column, width: Column) -> Column:
    """The lines of a text in a box: a fold over the words of each paragraph; the units of a line are kept beside it, so no word is measured twice."""
    return let(standard_name(font), lambda base: _wrap(text, base, size, width))


def _wrap(text: Column, base: Column, size: Column, width: Column) -> Column:
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    room = width * F.lit(1000.0) / size
    space = _base_units(F.lit(" "), base)

    def lines(paragraph):
        words = F.transform(F.split(F.rtrim(paragraph), " "), lambda w: F.struct(w.alias("w"), _base_units(w, base).alias("u")))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("line"), F.lit(0).alias("u"))

        def step(acc, word):
            longer = F.when(acc["line"] == "", word["w"]).otherwise(F.concat_ws(" ", acc["line"], word["w"]))
            units = F.when(acc["line"] == "", word["u"]).otherwise(acc["u"] + space + word["u"])
            full = (width > 0) & (units > room) & (acc["line"] != "")
            return F.struct(
                F.when(full, F.array_append(acc["out"], acc["line"])).otherwise(acc["out"]).alias("out"),
                F.when(full, word["w"]).otherwise(longer).alias("line"),
                F.when(full, word["u"]).otherwise(units).alias("u"),
            )

        return F.aggregate(words, start, step, lambda acc: F.array_append(acc["out"], acc["line"]))

    return F.flatten(F.transform(paragraphs, lines))


def placed(lines: Column, font: Column, size: Column, box: Column, align: Column, valign: Column, spacing: Column) -> Column:
    """struct(x, baseline, text, width) of each line in a box; y runs down."""
    return let(standard_name(font), lambda base: _placed(lines, base, size, box, align, valign, spacing))


def _placed(lines, base, size, box, align, valign, spacing) -> Column:
    step = size * spacing
    total = F.size(lines) * step
    top = F.when(valign == "center", box["y0"] + (box["y1"] - box["y0"] - total) / 2).when(valign == "bottom", box["y1"] - total).otherwise(box["y0"])

    def one(line, k):
        def at(w):
            x = F.when(align == "center", box["x0"] + (box["x1"] - box["x0"] - w) / 2).when(align == "right", box["x1"] - w).otherwise(box["x0"])
            return F.struct(x.alias("x"), (top + k * step + size * 0.8).alias("baseline"), line.alias("text"), w.alias("width"))

        return let(_base_units(line, base) / F.lit(1000.0) * size, at)

    return F.transform(lines, one)


def used_bounds(found: Column, size: Column, spacing: Column) -> Column:
    """The rectangle that placed lines take up."""
    top = F.get(found, 0)["baseline"] - size * 0.8
    low, high = F.array_min(F.transform(found, lambda x: x["x"])), F.array_max(F.transform(found, lambda x: x["x"] + x["width"]))
    return F.struct(low.alias("x0"), top.alias("y0"), high.alias("x1"), (top + F.size(found) * size * spacing).alias("y1"))


def number(value: Column, places: int = 4) -> Column:
    """A number without needless zeros."""
    text = F.regexp_replace(F.format_string(f"%.{places}f", value), "\\.?0+$", "")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.when(text == "-0", "0").otherwise(text))


def literal(text: Column) -> Column:
    return F.concat(F.lit("("), F.regexp_replace(text, "([\\\\()])", "\\\\$1"), F.lit(")"))


def color_operator(r: Column, g: Column, b: Column) -> Column:
    return F.concat_ws(" ", number(r), number(g), number(b), F.lit("rg"))


def draw_operator(x: Column, y: Column, text: Column, resource: Column, size: Column) -> Column:
    """The operators that show a line with its baseline at (x, y), y up."""
    return F.concat(F.lit("q BT /"), resource, F.lit(" "), number(size), F.lit(" Tf "), number(x), F.lit(" "), number(y), F.lit(" Td "), literal(text), F.lit(" Tj ET Q"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(*[F.floor((255 - v) * (255 - k) / 255).cast("int").alias(n) for n, v in zip("rgb", (c, m, y))])


def is_blank(text: Column) -> Column:
    """Only NUL and ASCII blanks, or nothing."""
    return F.trim(text, F.lit("\0\t\n\x0b\x0c\r ")) == ""


def needs_space(before_x1: Column, before_size: Column, x0: Column) -> Column:
    return F.coalesce(x0 - before_x1 > 0.25 * before_size, F.lit(False))
