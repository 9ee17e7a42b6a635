"""Interpolation between a density and a measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massflow.functions import geometry as G
from massflow.operators.cells import power_cells


def displaced(cells: DataFrame, frames: int, area: float = 490.0) -> DataFrame:
    """(site_id, t, x, y, r, gray) for t = 0 ... 1: disks that move from their site to their cell's centroid.

    ``cells`` has (site_id, x, y, m, mu, vs). A disk's radius grows from 0 to that of its
    cell about the centroid; its gray is its mass against the mass of its area under the uniform density of ``area``. One frame is that of t = 0.
    """
    c = cells.where("size(vs) > 0").withColumn("c", G.centroid(F.col("vs"))).where("c is not null")
    full = F.array_max(F.transform("vs", lambda v: F.hypot(v["x"] - F.col("c.x"), v["y"] - F.col("c.y"))))
    c = c.withColumn("full", full).withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: i / F.lit(max(1e0, frames - 1e0)))))
    between = lambda a, b: (1 - F.col("t")) * a + F.col("t") * b
    r = between(F.lit(0e0), F.col("full"))
    per_pixel = F.lit(1 / area)
    gray = F.least(F.lit(255e0), F.coalesce(F.lit(255e0) * F.col("m") / F.nullif(F.lit(3.141592653589793) * r * r * per_pixel, F.lit(0e0)), F.lit(255e0)))
    return c.select("site_id", "t", between(F.col("x"), F.col("c.x")).alias("x"), between(F.col("y"), F.col("c.y")).alias("y"), r.alias("r"), gray.alias("gray"))


def morphed(sites: DataFrame, frames: int, gray_from: float, gray_to: float, total_area: float) -> DataFrame:
    """(site_id, t, area, gray): the power diagrams of t * w for t = 0 ... 1."""
    out = None
    for i in range(frames):
        t = i / max(1, frames - 1)
        cells = power_cells(sites.withColumn("w", F.col("w") * t)).withColumn("area", G.area(F.col("vs"))).where("area > 0")
        mean = t * gray_from + (1 - t) * gray_to
        frame = cells.join(sites.select("site_id", "m"), "site_id").select("site_id", F.lit(t).alias("t"), "area", (F.col("m") * mean * total_area / F.col("area")).alias("gray"))
        out = frame if out is None else out.unionByName(frame)
    return out


def level_gray(cells: DataFrame, total_area: float) -> DataFrame:
    """(site_id, area, gray): cells shaded by their site's mass against their area; hidden sites left out."""
    a = cells.withColumn("area", G.area(F.col("vs"))).where("area > 0")
    return a.select("site_id", "area", F.greatest(F.lit(0e0), F.least(F.lit(255e0), F.col("m") * 128e0 * total_area / F.col("area"))).alias("gray"))


def arrows(cells: DataFrame, share: float = 1.0) -> DataFrame:
    """(site_id, x, y, tx, ty): from each site the first ``share`` of the way to its cell's centroid; hidden sites left out.

    ``cells`` has (site_id, x, y, vs).
    """
    c = cells.where("size(vs) > 0").withColumn("c", G.centroid(F.col("vs"))).where("c is not null")
    to = lambda a: F.col(a) + F.lit(share) * (F.col(f"c.{a}") - F.col(a))
    return c.select("site_id", "x", "y", to("x").alias("tx"), to("y").alias("ty"))
