"""Polygon measures and tests as Column expressions.

A geometry is an array of polygons, a polygon an array of closed rings (shell
first, holes after), a ring an array of ``struct<x, y>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SQ_METRES_PER_ACRE = 4046.86


def _num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def point(x, y) -> Column:
    return F.struct(_num(x).cast("double").alias("x"), _num(y).cast("double").alias("y"))


def ring(corners) -> Column:
    """Closed ring through the given (x, y) corners."""
    corners = list(corners)
    return F.array(*[point(x, y) for x, y in corners + corners[:1]])


def polygon(shell, *holes) -> Column:
    """Single-polygon geometry from corner lists."""
    return F.array(F.array(ring(shell), *[ring(h) for h in holes]))


def box(x0, y0, x1, y1) -> Column:
    x0, y0, x1, y1 = map(_num, (x0, y0, x1, y1))
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def ring_edges(points: Column) -> Column:
    """Consecutive point pairs of a ring or line as ``array<struct<ax, ay, bx, by>>``."""
    n = F.size(points)
    return F.zip_with(
        F.slice(points, F.lit(1), n - 1),
        F.slice(points, F.lit(2), n - 1),
        lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")),
    )


def edges(geom: Column) -> Column:
    """All edges of all rings."""
    return F.flatten(F.transform(F.flatten(geom), ring_edges))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _ring_sign(index: Column) -> Column:
    return F.when(index == 0, 1.0).otherwise(-1.0)


def _ring_area(points: Column) -> Column:
    """Shoelace area of one ring, whichever way it runs."""
    doubled = F.aggregate(ring_edges(points), F.lit(0.0), lambda acc, e: acc + (e.ax * e.by - e.bx * e.ay))
    return F.abs(doubled) / 2.0


def area(geom: Column) -> Column:
    """Shell areas less hole areas."""
    signed = F.flatten(F.transform(geom, lambda poly: F.transform(poly, lambda r, i: _ring_sign(i) * _ring_area(r))))
    return _total(signed)


def perimeter(geom: Column) -> Column:
    """Length of every ring, holes included."""
    return F.aggregate(edges(geom), F.lit(0.0), lambda acc, e: acc + F.hypot(e.bx - e.ax, e.by - e.ay))


def centroid(geom: Column) -> Column:
    """Area centroid as ``struct<x, y>``; null when the area is zero.

    Moments are taken about the first point, so that a small polygon far from the origin
    loses no digits, and divided once: a box with whole corners has its exact centre.
    """
    return F.get(F.transform(F.array(geom), lambda g: _centroid_about(g, F.get(F.flatten(F.flatten(g)), F.lit(0)))), F.lit(0))


def _centroid_about(geom: Column, origin: Column) -> Column:
    def moments(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e.ax - origin.x, e.ay - origin.y, e.bx - origin.x, e.by - origin.y
        cross = ax * by - bx * ay
        return F.struct(
            (acc.a + cross).alias("a"),
            (acc.mx + (ax + bx) * cross).alias("mx"),
            (acc.my + (ay + by) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    rings = F.flatten(
        F.transform(
            geom,
            lambda poly: F.transform(
                poly,
                lambda r, i: F.struct(F.aggregate(ring_edges(r), zero, moments).alias("m"), _ring_sign(i).alias("s")),
            ),
        )
    )

    # A ring may run either way round; shells count up and holes count down.
    def combine(acc: Column, r: Column) -> Column:
        turn = F.when(r.m.a < 0, -r.s).otherwise(r.s)
        return F.struct(
            (acc.a + turn * r.m.a).alias("a"), (acc.mx + turn * r.m.mx).alias("mx"), (acc.my + turn * r.m.my).alias("my")
        )

    def centre(acc: Column) -> Column:
        weight = F.nullif(acc.a, F.lit(0.0)) * 3.0
        return F.struct((origin.x + acc.mx / weight).alias("x"), (origin.y + acc.my / weight).alias("y"))

    return F.aggregate(rings, zero, combine, centre)


def bounds(geom: Column) -> Column:
    """``struct<xmin, ymin, xmax, ymax>``."""
    pts = F.flatten(F.flatten(geom))
    xs, ys = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def contains_point(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd test, half-open: a point on a shared edge belongs to exactly one side."""
    crossings = F.filter(
        edge_list,
        lambda e: ((e.ay > y) != (e.by > y)) & (x < e.ax + (y - e.ay) * (e.bx - e.ax) / (e.by - e.ay)),
    )
    return F.size(crossings) % 2 == 1


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed bounding-box overlap of two ``{xmin, ymin, xmax, ymax}`` sets of columns."""
    tests = [a["xmin"] <= b["xmax"], a["xmax"] >= b["xmin"], a["ymin"] <= b["ymax"], a["ymax"] >= b["ymin"]]
    return reduce(lambda p, q: p & q, tests)


def acres(square_metres: Column) -> Column:
    return square_metres / F.lit(SQ_METRES_PER_ACRE)
