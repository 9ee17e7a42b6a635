"""The transport objective and what is read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massflow.operators.greedy import greedy_bound


def value(stats: DataFrame) -> DataFrame:
    """One row: f (convex in w, to be minimised), the squared distance and the number of active sites.

    ``stats`` has (site_id, w, mu, sqint, g) of all sites, empty ones included.
    """
    return stats.agg((-(F.sum("sqint") - F.sum(F.col("g") * F.col("w")))).alias("f"), F.sum("sqint").alias("w2_squared"), F.count_if(F.col("mu") != 0).alias("active"))


def norms(stats: DataFrame, p: float = 3.0) -> DataFrame:
    """One row: the 1-, 2-, p- and infinity norm of the gradient."""
    a = F.abs("g")
    return stats.agg(F.sum(a).alias("norm_1"), F.sqrt(F.sum(a * a)).alias("norm_2"), F.pow(F.sum(F.pow(a, p)), 1 / p).alias("norm_p"), F.max(a).alias("norm_inf"))


def misaffected(stats: DataFrame) -> DataFrame:
    """One row: half the gradient's 1-norm, and the mass of excess and of lack."""
    g = F.col("g")
    return stats.agg((F.sum(F.abs(g)) / 2).alias("misaffected"), F.sum(F.when(g > 0, g).otherwise(0e0)).alias("excess"), F.sum(F.when(g <= 0, -g).otherwise(0e0)).alias("lack"))


def trivial_bound(stats: DataFrame) -> DataFrame:
    """One row: the sites' diameter, and the error bound sqrt(misaffected) * diameter."""
    box = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return stats.agg(box.alias("diameter"), (F.sqrt(F.sum(F.abs("g")) / 2) * box).alias("bound"))


def hessian(edges: DataFrame, sites: DataFrame, domain_area: float) -> DataFrame:
    """(i, j, h): of f under the uniform density; a row's entries sum to 0, hidden sites have none."""
    at = lambda p: sites.select(F.col("site_id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    e = edges.select(F.col("site_id").alias("i"), F.col("neighbour").alias("j"), "len").join(at("i"), "i").join(at("j"), "j")
    off = e.select("i", "j", (-F.col("len") / domain_area / (2 * F.hypot(F.col("ix") - F.col("jx"), F.col("iy") - F.col("jy")))).alias("h"))
    return off.unionByName(off.groupBy("i").agg((-F.sum("h")).alias("h")).select("i", F.col("i").alias("j"), "h"))


def error_bound(stats: DataFrame) -> float:
    """The lesser of what the greedy walk and the sites' diameter say of the distance's error."""
    return min(greedy_bound(stats), trivial_bound(stats).first()["bound"] or 0.0)


def distance_to(weights: DataFrame, known: DataFrame) -> DataFrame:
    """One row (distance, n): how far weights (site_id, w) are from ``known`` ones, shifts left out, per site."""
    d = weights.select("site_id", "w").join(known.select("site_id", F.col("w").alias("k")), "site_id").select((F.col("w") - F.col("k")).alias("d"))
    return d.agg((F.sqrt(F.greatest(F.lit(0e0), F.count("*") * F.var_pop("d"))) / F.count("*")).alias("distance"), F.count("*").alias("n"))


def running_bounds(log: DataFrame) -> DataFrame:
    """``log`` (run, iteration, w, werr) with wmin and wmax: what all steps of the run so far leave of the distance."""
    before = Window.partitionBy("run").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("wmin", F.greatest(F.lit(0e0), F.max(F.col("w") - F.col("werr")).over(before))).withColumn("wmax", F.min(F.col("w") + F.col("werr")).over(before))
