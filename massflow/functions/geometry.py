"""Planar geometry as column expressions.

A polygon is an array of (x, y) in counter-clockwise order. Nothing here runs
Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(array() AS array<struct<x:double,y:double>>)"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def let(value: Column, f) -> Column:
    """f(value) with ``value`` bound as a lambda's variable: computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _next(vs: Column) -> Column:
    """For each vertex, the one after it."""
    return F.concat(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0))), F.slice(vs, 1, 1))


def over_edges(vs: Column, f) -> Column:
    """The sum of f(a, b) over a polygon's edges a -> b."""
    terms = let(vs, lambda v: F.when(F.size(v) > 0, F.zip_with(v, _next(v), f)).otherwise(F.array().cast("array<double>")))
    return F.aggregate(terms, F.lit(0e0), lambda s, t: s + t)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def area(vs: Column) -> Column:
    """Signed area: positive counter-clockwise, 0 without vertices."""
    return over_edges(vs, _cross) / 2


def first_moments(vs: Column) -> tuple[Column, Column]:
    """The integrals of x and of y over a polygon."""
    part = lambda c: over_edges(vs, lambda a, b: (a[c] + b[c]) * _cross(a, b)) / 6
    return part("x"), part("y")


def centroid(vs: Column) -> Column:
    """The centroid; null where the area is 0."""
    mx, my = first_moments(vs)
    a = F.nullif(area(vs), F.lit(0e0))
    return F.when(a.isNotNull(), point(mx / a, my / a))


def squared_distance_integral(vs: Column, px: Column, py: Column) -> Column:
    """The integral of the squared distance to (px, py) over a polygon.

    A fan of triangles from (px, py), as in a polar moment about that point.
    """

    def term(a: Column, b: Column) -> Column:
        ax, ay, bx, by = a["x"] - px, a["y"] - py, b["x"] - px, b["y"] - py
        return (ax * by - bx * ay) * (ax * ax + ax * bx + bx * bx + ay * ay + ay * by + by * by)

    return over_edges(vs, term) / 12


def bounds(vs: Column) -> Column:
    """struct(x0, y0, x1, y1), null without vertices."""
    xs, ys = F.transform(vs, lambda v: v["x"]), F.transform(vs, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def clamp_radius(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Twice the greater distance from the origin of a box's least and greatest corner."""
    return 2 * F.greatest(F.hypot(x0, y0), F.hypot(x1, y1))


def inside(vs: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) is strictly inside a convex polygon."""
    left = F.zip_with(vs, _next(vs), lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    return (F.size(vs) > 2) & F.forall(left, lambda t: t > 0)


def cut(vs: Column, a: Column, b: Column, c: Column) -> Column:
    """The part of a convex polygon where a * x + b * y <= c (Sutherland-Hodgman)."""
    gap = lambda v: c - a * v["x"] - b * v["y"]

    def step(p: Column, q: Column) -> Column:
        return let(F.struct(gap(p).alias("p"), gap(q).alias("q")), lambda g: kept(p, q, g["p"], g["q"]))

    def kept(p: Column, q: Column, gp: Column, gq: Column) -> Column:
        t = gp / F.nullif(gp - gq, F.lit(0e0))
        keep = F.when(gp >= 0, F.array(point(p["x"], p["y"]))).otherwise(F.expr(EMPTY))
        crossing = F.when(((gp > 0) & (gq < 0)) | ((gp < 0) & (gq > 0)), F.array(point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"])))).otherwise(F.expr(EMPTY))
        return F.concat(keep, crossing)

    return let(vs, lambda v: F.when(F.size(v) > 0, F.flatten(F.zip_with(v, _next(v), step))).otherwise(F.expr(EMPTY)))


def cut_all(vs: Column, halves: Column) -> Column:
    """``vs`` within all half-planes of an array of struct(a, b, c)."""
    return F.aggregate(halves, vs, lambda poly, h: cut(poly, h["a"], h["b"], h["c"]))


def edges_as_halves(vs: Column) -> Column:
    """The half-planes whose intersection is a counter-clockwise convex polygon."""
    return F.zip_with(vs, _next(vs), lambda p, q: F.struct((q["y"] - p["y"]).alias("a"), (p["x"] - q["x"]).alias("b"), ((q["y"] - p["y"]) * p["x"] - (q["x"] - p["x"]) * p["y"]).alias("c")))


def intersection(p: Column, q: Column) -> Column:
    """The convex intersection of two convex polygons, empty where they don't overlap."""
    return cut_all(p, edges_as_halves(q))


def line_in(vs: Column, x0: Column, y0: Column, dx: Column, dy: Column, first: Column, last: Column | None) -> Column:
    """struct(t0, t1): for which t in [first, last] (no end where ``last`` is None) the point
    (x0 + t * dx, y0 + t * dy) is in a convex polygon (Cyrus-Beck); null if none or only one."""
    halves = edges_as_halves(vs)
    gap = lambda h: h["c"] - h["a"] * x0 - h["b"] * y0
    rate = lambda h: h["a"] * dx + h["b"] * dy
    ends = lambda on: F.transform(F.filter(halves, on), lambda h: gap(h) / rate(h))
    enter = F.array_max(F.concat(F.array(first), ends(lambda h: rate(h) < 0)))
    leaving = ends(lambda h: rate(h) > 0)
    leave = F.array_min(leaving if last is None else F.concat(F.array(last), leaving))
    outside = F.exists(halves, lambda h: (rate(h) == 0) & (gap(h) < 0))
    return F.when(~outside & (enter < leave), F.struct(enter.alias("t0"), leave.alias("t1")))


def segment_in(vs: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(t0, t1): the part of a segment in a convex polygon; null if none."""
    return line_in(vs, x0, y0, x1 - x0, y1 - y0, F.lit(0e0), F.lit(1e0))


def ray_in(vs: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    """struct(t0, t1): the part of a ray from (x0, y0) in a convex polygon, in lengths of (dx, dy); null if none."""
    return line_in(vs, x0, y0, dx, dy, F.lit(0e0), None)
