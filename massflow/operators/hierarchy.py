"""Hierarchies of measures: hier(level, site_id, x, y, m, parent_id), level 0 the finest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(hier: DataFrame, low: int, high: int) -> DataFrame:
    """(site_id, ancestor): for the sites of level ``low``, their ancestor of level ``high``."""
    found = hier.where(F.col("level") == low).select("site_id", F.col("site_id").alias("ancestor"))
    for level in range(low, high):
        up = hier.where(F.col("level") == level).select(F.col("site_id").alias("ancestor"), "parent_id")
        found = found.join(up, "ancestor").select("site_id", F.col("parent_id").alias("ancestor"))
    return found


def prolonged(hier: DataFrame, weights: DataFrame, low: int, high: int) -> DataFrame:
    """(site_id, w): sites of level ``low`` with their ancestor's weight; 0 where it has none."""
    w = weights.select(F.col("site_id").alias("ancestor"), "w")
    return ancestors(hier, low, high).join(w, "ancestor", "left").select("site_id", F.coalesce("w", F.lit(0e0)).alias("w"))


def transport_distance(hier: DataFrame, low: int, high: int) -> DataFrame:
    """One row (low, high, w2): the quadratic distance when each site's mass moves to its ancestor."""
    below = hier.where(F.col("level") == low).select("site_id", "x", "y", "m")
    above = hier.where(F.col("level") == high).select(F.col("site_id").alias("ancestor"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    d2 = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    moved = below.join(ancestors(hier, low, high), "site_id").join(above, "ancestor")
    return moved.agg(F.sqrt(F.sum(F.col("m") * d2)).alias("w2")).select(F.lit(low).alias("low"), F.lit(high).alias("high"), "w2")


def rolled_up(hier: DataFrame) -> DataFrame:
    """(level, site_id, m, child_m, n_children): each parent's mass beside its children's."""
    parents = hier.where("level > 0").select("level", "site_id", "m")
    children = hier.where("parent_id is not null").groupBy((F.col("level") + 1).alias("level"), F.col("parent_id").alias("site_id")).agg(F.sum("m").alias("child_m"), F.count("*").alias("n_children"))
    return parents.join(children, ["level", "site_id"], "left")
