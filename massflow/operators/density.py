"""Aggregates of raster and uniform densities over polygons and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massflow.functions import geometry as G


def _unit(x: Column, y: Column) -> list[tuple[Column, Column, Column]]:
    """The half-planes of the pixel [x, x + 1] x [y, y + 1]."""
    one, zero = F.lit(1e0), F.lit(0e0)
    return [(one, zero, x + 1e0), (-one, zero, -x), (zero, one, y + 1e0), (zero, -one, -y)]


def coverage(polygons: DataFrame, key: str, exact: bool = True, moments: bool = False) -> DataFrame:
    """(key, x, y, cov): each pixel that a convex polygon touches and the area of their overlap.

    With ``moments`` also mx, my and mm, the overlap's integrals of x, y and x^2 + y^2.

    A polygon becomes rows for its bounding box's columns first; each column's strip
    is clipped once and gives rows for the pixels of the strip's own height. With
    ``exact`` False a touched pixel counts as covered.
    """
    box = polygons.select(key, "vs", G.bounds(F.col("vs")).alias("b")).where("size(vs) > 2")
    columns = box.select(key, "vs", F.explode(F.sequence(F.floor("b.x0").cast("int"), (F.ceil("b.x1") - 1).cast("int"))).alias("x"))
    x = F.col("x").cast("double")
    strip = G.cut(G.cut(F.col("vs"), F.lit(1e0), F.lit(0e0), x + 1e0), F.lit(-1e0), F.lit(0e0), -x)
    strips = columns.select(key, "x", F.inline(F.array(F.struct(strip.alias("strip")))))
    strips = strips.where("size(strip) > 2").select(key, "x", "strip", G.bounds(F.col("strip")).alias("b"))
    cells = strips.select(key, "x", "strip", F.explode(F.sequence(F.floor("b.y0").cast("int"), F.greatest(F.floor("b.y0"), F.ceil("b.y1") - 1).cast("int"))).alias("y"))
    y = F.col("y").cast("double")
    part = G.cut(G.cut(F.col("strip"), F.lit(0e0), F.lit(1e0), y + 1e0), F.lit(0e0), F.lit(-1e0), -y)
    if moments:
        of = F.col("part")
        mx, my = G.first_moments(of)
        parts = cells.select(key, "x", "y", F.inline(F.array(F.struct(part.alias("part")))))
        return parts.select(key, "x", "y", G.area(of).alias("cov"), mx.alias("mx"), my.alias("my"), G.squared_distance_integral(of, F.lit(0e0), F.lit(0e0)).alias("mm")).where("cov > 0")
    found = cells.select(key, "x", "y", G.area(part).alias("cov")).where("cov > 0")
    return found if exact else found.withColumn("cov", F.lit(1e0))


def over_pixels(covered: DataFrame, pixels: DataFrame) -> DataFrame:
    """``covered`` (x, y, ...) with the pixels' values v; pixels without a row have none."""
    return covered.join(pixels, ["x", "y"])


def image_moments(polygons: DataFrame, pixels: DataFrame, key: str, truncate: bool = False) -> DataFrame:
    """Per polygon: mass, centroid (null without mass) and number of pixels with a value.

    A pixel stands at its lower left corner in the centroid. ``truncate`` cuts each
    pixel's part of the centroid's mass to an integer, as some 8-bit tools do.
    """
    c = over_pixels(coverage(polygons, key), pixels).withColumn("part", F.col("cov") * F.col("v"))
    m = F.col("part").cast("int") if truncate else F.col("part")
    got = c.groupBy(key).agg(F.sum("part").alias("mass"), F.sum(m * F.col("x")).alias("mx"), F.sum(m * F.col("y")).alias("my"), F.sum(m).alias("mm"), F.count("*").alias("n_pixels"))
    whole = F.nullif(F.col("mm"), F.lit(0e0))
    both = polygons.select(key).join(got, key, "left")
    return both.select(key, F.coalesce("mass", F.lit(0e0)).alias("mass"), (F.col("mx") / whole).alias("cx"), (F.col("my") / whole).alias("cy"), F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"))


def image_integral(polygons: DataFrame, pixels: DataFrame, key: str, integrand) -> DataFrame:
    """Per polygon: the sum of cov * f(x, y) * v; ``integrand`` makes f from columns."""
    c = over_pixels(coverage(polygons, key), pixels)
    return c.groupBy(key).agg(F.sum(F.col("cov") * integrand(F.col("x").cast("double"), F.col("y").cast("double")) * F.col("v")).alias("integral"))


def cell_image_moments(cells: DataFrame, sites: DataFrame, pixels: DataFrame, corners: bool = True) -> DataFrame:
    """Per site, of a raster's density over its cell (site_id, vs): mu, cx, cy, sqint (about the site) and g = mu - m.

    The density is the raster within all cells together, of total 1. A pixel is
    covered exactly; in the moments its part of a cell stands at the pixel's lower
    left corner, or where it is if not ``corners``. A cell without mass has null cx and cy.
    """
    c = over_pixels(coverage(cells, "site_id", moments=not corners), pixels)
    if corners:
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        c = c.withColumns({"mx": F.col("cov") * x, "my": F.col("cov") * y, "mm": F.col("cov") * (x * x + y * y)})
    sums = c.groupBy("site_id").agg(F.sum(F.col("cov") * F.col("v")).alias("mass"), *(F.sum(F.col(k) * F.col("v")).alias(k) for k in ("mx", "my", "mm")))
    total = sums.agg(F.sum("mass").alias("total"))
    both = sites.join(sums, "site_id", "left").crossJoin(F.broadcast(total))
    x, y, whole = F.col("x"), F.col("y"), F.nullif(F.col("mass"), F.lit(0e0))
    mu = F.coalesce(F.col("mass") / F.col("total"), F.lit(0e0))
    square = F.col("mm") - 2 * x * F.col("mx") - 2 * y * F.col("my") + (x * x + y * y) * F.col("mass")
    return both.select("site_id", "x", "y", "m", "w", mu.alias("mu"), (F.col("mx") / whole).alias("cx"), (F.col("my") / whole).alias("cy"), F.coalesce(square / F.col("total"), F.lit(0e0)).alias("sqint"), (mu - F.col("m")).alias("g"))


def segment_pixels(segments: DataFrame, key: str) -> DataFrame:
    """(key, x, y, len): the pixels along each segment and the length in each.

    Between two neighbouring crossings of the grid's lines a segment is in one pixel.
    """
    lines = lambda a, b: F.when(F.col(a) != F.col(b), F.transform(
        F.filter(F.sequence(F.floor(F.least(a, b)).cast("int"), F.ceil(F.greatest(a, b)).cast("int")), lambda i: (i > F.least(a, b)) & (i < F.greatest(a, b))),
        lambda i: (i - F.col(a)) / (F.col(b) - F.col(a)))).otherwise(F.expr("cast(array() AS array<double>)"))
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0e0), F.lit(1e0)), lines("x0", "x1"), lines("y0", "y1"))))
    parts = segments.select(key, "x0", "y0", "x1", "y1", stops.alias("t")).select("*", F.posexplode("t").alias("i", "lo"))
    parts = parts.withColumn("hi", F.get("t", F.col("i") + 1)).where("hi is not null")
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * (F.col("lo") + F.col("hi")) / 2).cast("int")
    return parts.select(key, at("x0", "x1").alias("x"), at("y0", "y1").alias("y"), ((F.col("hi") - F.col("lo")) * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("len"))


def uniform_moments(polygons: DataFrame, key: str, domain_area: float) -> DataFrame:
    """Per polygon, of the uniform density of total 1: mass, centroid, integral of the squared
    distance to the first vertex."""
    vs = F.col("vs")
    c = G.centroid(vs)
    first = vs[0]
    return polygons.select(key, (G.area(vs) / domain_area).alias("mass"), c["x"].alias("cx"), c["y"].alias("cy"), (G.squared_distance_integral(vs, first["x"], first["y"]) / domain_area).alias("sqint"))


def segment_integrals(segments: DataFrame, key: str, domain_area: float) -> DataFrame:
    """Per segment, of the uniform density: length mass and the integral of the squared distance to (0, 0)."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    length = F.hypot(x1 - x0, y1 - y0)
    square = length * (length * length / 3 + (x1 - x0) * x0 + (y1 - y0) * y0 + x0 * x0 + y0 * y0)
    return segments.select(key, (length / domain_area).alias("mass"), (square / domain_area).alias("sqint"))
