"""Rectangles (x0, y0, x1, y1) as arrays of double, and the geometry envelope of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<coordinate_system:string,units:string,rect:array<double>,page_rect:array<double>,rotation:int,spans:array<struct<text:string,rect:array<double>>>>"


def area(r: Column) -> Column:
    return (r[2] - r[0]) * (r[3] - r[1])


def overlap(a: Column, b: Column) -> Column:
    """The shared area as a part of the smaller rectangle; null where that has no area."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.try_divide(width * height, F.least(area(a), area(b)))


def same_rect(a: Column, b: Column, within: float = 0.01) -> Column:
    return F.coalesce(F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d < within), F.lit(False))


def valid(g: Column) -> Column:
    """Whether an envelope is complete: known system and unit, rectangle inside a page with an area."""
    r, p = g["rect"], g["page_rect"]
    sizes = (F.size(r) == 4) & (F.size(p) == 4)
    inside = (r[0] >= p[0]) & (r[1] >= p[1]) & (r[2] <= p[2]) & (r[3] <= p[3])
    real = (r[2] > r[0]) & (r[3] > r[1]) & (p[2] > p[0]) & (p[3] > p[1])
    turn = F.coalesce(g["rotation"], F.lit(0)).isin(0, 90, 180, 270)
    known = (g["coordinate_system"] == "pymupdf_unrotated") & (g["units"] == "pt")
    return F.coalesce(F.when(sizes, inside & real & turn & known).otherwise(False), F.lit(False))


def parse(x: Column) -> Column:
    """An envelope from JSON; null unless it is valid."""
    g = F.from_json(x, GEOMETRY)
    return F.when(valid(g), g)


def union(a: Column, b: Column) -> Column:
    """The smallest rectangle around both."""
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def rounded(r: Column) -> Column:
    return F.transform(r, lambda x: F.bround(x, 3))


def selection(rects: Column, bounds: Column, view: Column, rotation: Column) -> Column:
    """The envelope of a selection on a rendered page, in points of the page as it is unrotated; null without a rectangle of some area.

    rects: array of rectangles on the screen. bounds: the page's rectangle on the screen, turned as it is shown. view: the
    page's box in its own points. rotation: 0, 90, 180 or 270 degrees clockwise. The envelope is clipped to the page.
    """
    w, h = view[2] - view[0], view[3] - view[1]
    turned = rotation.isin(90, 270)
    shown_w, shown_h = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    real = F.filter(rects, lambda r: (r[2] > r[0]) & (r[3] > r[1]))
    # on the page as it is shown, from its upper left corner
    px = lambda x: (x - bounds[0]) * shown_w / (bounds[2] - bounds[0])
    py = lambda y: (y - bounds[1]) * shown_h / (bounds[3] - bounds[1])

    def back(x, y):
        u = F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, w - y).otherwise(x)
        v = F.when(rotation == 90, h - x).when(rotation == 180, h - y).when(rotation == 270, x).otherwise(y)
        return u, v

    def edges(r):
        a, b = back(px(r[0]), py(r[1])), back(px(r[2]), py(r[3]))
        return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[0], b[0]), F.greatest(a[1], b[1]))

    each = F.transform(real, edges)
    side = lambda i, pick: pick(F.transform(each, lambda r: r[i]))
    zero = F.lit(0.0)
    rect = F.array(F.greatest(zero, side(0, F.array_min)), F.greatest(zero, side(1, F.array_min)), F.least(w, side(2, F.array_max)), F.least(h, side(3, F.array_max)))
    spans = F.array().cast("array<struct<text:string,rect:array<double>>>")
    return F.when(F.size(real) > 0, F.struct(F.lit("pymupdf_unrotated").alias("coordinate_system"), F.lit("pt").alias("units"), rect.alias("rect"), F.array(zero, zero, w, h).alias("page_rect"), rotation.cast("int").alias("rotation"), spans.alias("spans")))
