"""Densities of total 1 over a convex domain, as Lloyd's steps, hierarchies and solvers use them.

A density tells its part in each cell (mass, centroid, integral of the squared
distance), draws places, and splits cells into places to begin with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.functions import geometry as G
from massflow.functions.clip import Grid
from massflow.operators import density, measure
from massflow.operators.cells import Sites, _cut_by, cell_edges, edged, measured, uniform_cell_moments
from massflow.sources.fixtures import DOMAIN

Place = tuple[float, float]
#: Draws for each place, should the first ones fall outside the domain.
TRIES = 16
#: Pixels of a raster's box that are sent to every task, 8 bytes each; larger rasters are joined.
HELD_PIXELS = 4_000_000


def _uniform(*key: Column) -> Column:
    """A number strictly between 0 and 1 that follows from the key alone."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def polygon_centroid(poly: list[Place], otherwise: np.ndarray | Place) -> np.ndarray:
    v = np.array(poly).reshape(-1, 2)
    u = np.roll(v, -1, axis=0)
    cross = v[:, 0] * u[:, 1] - u[:, 0] * v[:, 1]
    return (v + u).T @ cross / (3 * cross.sum()) if len(v) and cross.sum() > 0 else np.array(otherwise)


@dataclass
class UniformDensity:
    domain: list[Place] = field(default_factory=lambda: DOMAIN)

    @property
    def area(self) -> float:
        xs = [*self.domain, self.domain[0]]
        return sum(a * d - c * b for (a, b), (c, d) in zip(xs, xs[1:], strict=False)) / 2

    @property
    def radius(self) -> float:
        """Twice the greater distance from the origin of the domain's box's corners: what thresholds of movement are parts of."""
        xs, ys = zip(*self.domain, strict=True)
        return 2 * max(hypot(min(xs), min(ys)), hypot(max(xs), max(ys)))

    def measured(self, spark: SparkSession, sites: Sites) -> pd.DataFrame | None:
        """Per held site in their order: mu, and mx, my, sqint, the integrals of dx, dy and dx^2 + dy^2 about the site; None if
        the density is too large for tasks to have it whole."""
        got = measured(spark, sites)
        return got[["mass", "mx", "my", "sq"]].set_axis(["mu", "mx", "my", "sqint"], axis=1) / self.area

    def edged(self, spark: SparkSession, sites: Sites) -> pd.DataFrame | None:
        """(place, neighbour, len): as ``edges``, of held sites; None likewise."""
        return edged(spark, sites)

    @property
    def polygon(self) -> Column:
        return F.array(*(G.point(F.lit(float(a)), F.lit(float(b))) for a, b in self.domain))

    def over(self, cells: DataFrame, sites: DataFrame) -> DataFrame:
        """Per site, of its cell (site_id, vs): mu, cx, cy (null without mass), sqint about the site, and g = mu - m."""
        return uniform_cell_moments(cells, sites, self.area)

    def edges(self, cells: DataFrame) -> DataFrame:
        """(site_id, neighbour, len): the density along the edges between cells (site_id, vs, neighbours), from both of their sides; ``total`` is
        what makes it 1 over the domain."""
        return cell_edges(cells)

    def total(self, spark: SparkSession) -> float:
        return self.area

    def centroid(self, spark: SparkSession) -> Place:
        x, y = polygon_centroid(self.domain, self.domain[0])
        return float(x), float(y)

    def placed(self, draws: DataFrame) -> DataFrame:
        """``draws`` (u1, u2, ...) with x and y; those that fall outside the domain are left out."""
        p = measure.polygon_point(self.polygon, F.col("u1"), F.col("u2"))
        return draws.withColumn("p", p).select(*draws.columns, "p.x", "p.y")

    def drawn(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """(site_id, x, y): ``n`` places, each by the first of its draws that falls inside the domain."""
        key = (F.lit(seed), F.col("site_id"), F.col("try"))
        draws = spark.range(n).withColumnRenamed("id", "site_id").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
        draws = draws.withColumns({"u1": _uniform(*key, F.lit(1)), "u2": _uniform(*key, F.lit(2))})
        first = self.placed(draws).groupBy("site_id").agg(F.min(F.struct("try", "x", "y")).alias("p"))
        return first.select("site_id", "p.x", "p.y")

    def split(self, cells: DataFrame, k: int, seed: int = 0, steps: int = 10) -> DataFrame:
        """(parent_id, j, x, y): each convex cell (site_id, vs) quantised by itself into ``k`` places by Lloyd's steps."""

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for site, vs in zip(batch["site_id"], batch["vs"], strict=True):
                    corners = np.array([(v["x"], v["y"]) for v in vs])
                    # uniform shares of the corners lie in the cell; Lloyd's steps spread them
                    at = np.random.default_rng([seed, abs(int(site))]).dirichlet(np.ones(len(corners)), k) @ corners
                    for _ in range(steps):
                        few = [(i, x, y, 0.0) for i, (x, y) in enumerate(at.tolist())]
                        cells = [_cut_by(corners.tolist(), [-1] * len(corners), x, y, 0.0, i, few[:i] + few[i + 1 :])[0] for i, x, y, _ in few]
                        at = np.array([polygon_centroid(c, at[i]) for i, c in enumerate(cells)])
                    out += [(site, j, *p) for j, p in enumerate(at.tolist())]
                yield pd.DataFrame(out, columns=["parent_id", "j", "x", "y"])

        return cells.where("size(vs) > 2").select("site_id", "vs").mapInPandas(split, "parent_id long, j int, x double, y double")


@dataclass
class RasterDensity(UniformDensity):
    """A raster (x, y, v) within the domain. With ``corners`` a pixel's part of a cell stands at the pixel's lower left corner in
    moments, as some tools have it; without, it is integrated where it is."""

    pixels: DataFrame | None = None
    corners: bool = False

    @cached_property
    def held(self) -> Grid | None:
        """The raster, if its box is no larger than HELD_PIXELS."""
        box = self.pixels.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if box[0] is not None and (box[1] - box[0] + 1) * (box[3] - box[2] + 1) > HELD_PIXELS:
            return None
        p = self.pixels.where("v is not null and x is not null and y is not null").groupBy("x", "y").agg(F.sum("v").alias("v")).toPandas()
        return Grid.of(p["x"].to_numpy(), p["y"].to_numpy(), p["v"].to_numpy(), self.corners)

    def measured(self, spark: SparkSession, sites: Sites) -> pd.DataFrame | None:
        if self.held is None:
            return None
        got = measured(spark, sites, self.held)
        return got[["mass", "mx", "my", "sq"]].set_axis(["mu", "mx", "my", "sqint"], axis=1) / (float(got["mass"].sum()) or 1.0)

    def edged(self, spark: SparkSession, sites: Sites) -> pd.DataFrame | None:
        return None if self.held is None else edged(spark, sites, self.held)

    def over(self, cells: DataFrame, sites: DataFrame) -> DataFrame:
        return density.cell_image_moments(cells.where("size(vs) > 2").select("site_id", "vs"), sites, self.pixels, corners=self.corners)

    def edges(self, cells: DataFrame) -> DataFrame:
        e = cells.where("size(vs) > 0").select("site_id", "vs", F.posexplode("neighbours").alias("i", "neighbour")).where("neighbour >= 0")
        p, q = F.element_at("vs", F.col("i") + 1), F.element_at("vs", (F.col("i") + 1) % F.size("vs") + 1)
        segments = e.select(F.struct("site_id", "neighbour").alias("e"), p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))
        met = density.over_pixels(density.segment_pixels(segments, "e"), self.pixels)
        return met.groupBy("e").agg(F.sum(F.col("len") * F.col("v")).alias("len")).select("e.*", "len").where("len > 1e-9")

    def total(self, spark: SparkSession) -> float:
        return density.image_moments(self._whole(spark), self.pixels, "site_id").first()["mass"]

    def _whole(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.col("id").alias("site_id"), self.polygon.alias("vs"))

    def centroid(self, spark: SparkSession) -> Place:
        one = self._whole(spark).select("site_id", F.lit(0e0).alias("x"), F.lit(0e0).alias("y"), F.lit(1e0).alias("m"), F.lit(0e0).alias("w"))
        r = self.over(self._whole(spark), one).first()
        return (r["cx"], r["cy"]) if r["cx"] is not None else super().centroid(spark)

    def placed(self, draws: DataFrame) -> DataFrame:
        width = (self.pixels.agg(F.max("x")).first()[0] or 0) + 1
        return measure.image_sample(draws, self.pixels, self.polygon, width)

    def split(self, cells: DataFrame, k: int, seed: int = 0, steps: int = 0) -> DataFrame:
        """(parent_id, j, x, y): ``k`` places in each cell, each in a pixel drawn by the pixels' masses in the cell.

        A pixel's waiting time is exponential with its mass as rate, so the first one is drawn by mass; a cell's
        first pixels are minima, which Spark finds without gathering the cell's pixels. Cells without mass give no places.
        """
        parts = density.over_pixels(density.coverage(cells.where("size(vs) > 2").select("site_id", "vs"), "site_id"), self.pixels).where("cov * v > 0")
        wait = lambda j: -F.log(_uniform(F.lit(seed), F.lit(j), F.col("site_id"), F.col("x"), F.col("y"))) / (F.col("cov") * F.col("v"))
        firsts = parts.groupBy("site_id").agg(F.array(*(F.min(F.struct(wait(j).alias("wait"), "x", "y")) for j in range(k))).alias("ps"))
        at = lambda c, i: F.col(f"p.{c}") + _uniform(F.lit(seed), F.lit(i), F.col("site_id"), F.col("j"))
        return firsts.select("site_id", F.posexplode("ps").alias("j", "p")).select(F.col("site_id").alias("parent_id"), "j", at("x", 1).alias("x"), at("y", 2).alias("y"))
