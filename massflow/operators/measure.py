"""Discrete measures: totals, running sums, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massflow.functions import geometry as G

#: Rows of a key range that are summed in one task.
RANGE = 4096


def normalised(df: DataFrame, mass: str = "m") -> DataFrame:
    """``df`` with masses of total 1."""
    total = df.agg(F.sum(mass).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(mass, F.col(mass) / F.col("__total")).drop("__total")


def running(df: DataFrame, key: Column, value: str, name: str = "cdf", width: int = RANGE) -> DataFrame:
    """``df`` with the running sum of ``value`` in the order of an integer ``key``.

    Ranges of keys are summed by themselves and then begin where the ranges before
    them end, so only one number per range passes through one task.
    """
    part = df.withColumn("__key", key.cast("long")).withColumn("__range", F.floor(F.col("__key") / width))
    sums = part.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0e0)).alias("__start"))
    inner = Window.partitionBy("__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    return part.join(starts, "__range").withColumn(name, F.col("__start") + F.sum(value).over(inner)).drop("__key", "__range", "__start")


def inverse_cdf(draws: DataFrame, measure: DataFrame, u: str, mass: str = "m", low: Column | None = None) -> DataFrame:
    """``draws`` with the row of ``measure`` (site_id, x, y, cdf) in whose interval (``low``, or cdf - m; cdf] ``u`` falls.

    The last interval ends at 1, should rounded sums end before. The unit interval is cut into as many bins as there are rows; a row goes to each
    bin that its interval meets and a draw to its own, so it is an equi-join.
    """
    n = measure.agg(F.count("*").alias("__n"), F.max("cdf").alias("__top"))
    rows = measure.crossJoin(F.broadcast(n)).withColumn("__lo", F.col("cdf") - F.col(mass) if low is None else low)
    rows = rows.withColumn("cdf", F.when(F.col("cdf") == F.col("__top"), F.greatest("cdf", F.lit(1e0))).otherwise(F.col("cdf"))).drop("__top")
    bin_of = lambda c: F.least(F.col("__n") - 1, F.greatest(F.lit(0), F.floor(c * F.col("__n")))).cast("long")
    rows = rows.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__lo") - 1e-9), bin_of(F.col("cdf") + 1e-9)))).drop("__n")
    picks = draws.crossJoin(F.broadcast(n)).withColumn("__bin", bin_of(F.col(u))).drop("__n", "__top")
    return picks.join(rows, "__bin").where((F.col(u) > F.col("__lo")) & (F.col(u) <= F.col("cdf"))).drop("__bin", "__lo")


def triangle_point(u1: Column, u2: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """A uniform point of a triangle from two uniform numbers, folded where they exceed 1 together."""
    fold = u1 + u2 > 1
    s, t = F.when(fold, 1 - u1).otherwise(u1), F.when(fold, 1 - u2).otherwise(u2)
    return ax + s * (bx - ax) + t * (cx - ax), ay + s * (by - ay) + t * (cy - ay)


def polygon_point(vs: Column, u1: Column, u2: Column) -> Column:
    """struct(x, y): a uniform point of a convex polygon from two uniform numbers.

    ``u1`` picks a triangle of the fan from the first vertex by area; what it leaves
    of its interval and ``u2`` pick a point of that triangle.
    """
    area = lambda v, i: ((v[i]["x"] - v[0]["x"]) * (v[i + 1]["y"] - v[0]["y"]) - (v[i + 1]["x"] - v[0]["x"]) * (v[i]["y"] - v[0]["y"])) / 2

    def picked(v: Column) -> Column:
        n = F.size(v) - 2
        sums = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0e0)), lambda a, i: F.concat(a, F.array(F.element_at(a, -1) + area(v, i))))
        return G.let(F.struct(sums.alias("sums"), (u1 * F.element_at(sums, -1)).alias("at")), lambda s: placed(v, n, s))

    def placed(v: Column, n: Column, s: Column) -> Column:
        # the first triangle whose end is not before the number; the last one, should rounding leave none
        i = F.least(n, F.size(F.filter(s["sums"], lambda c: c < s["at"])).cast("int"))
        i = F.greatest(i, F.lit(1))
        rest = (s["at"] - s["sums"][i - 1]) / (s["sums"][i] - s["sums"][i - 1])
        x, y = triangle_point(rest, u2, v[0]["x"], v[0]["y"], v[i]["x"], v[i]["y"], v[i + 1]["x"], v[i + 1]["y"])
        return G.point(x, y)

    return G.let(vs, picked)


def image_sample(draws: DataFrame, pixels: DataFrame, domain: Column, width: int, u1: str = "u1", u2: str = "u2") -> DataFrame:
    """``draws`` with x and y, places drawn from a raster: a pixel by its share of the raster's sum, then a place in it.

    What ``u1`` leaves of its pixel's interval is the place's x in it, and ``u2`` its y.
    Draws that don't fall strictly inside the convex polygon ``domain`` are left out;
    who needs a number of places draws more.
    """
    # sums of whole numbers, divided once: what a sum of fractions rounds would show in the places
    total = pixels.agg(F.sum("v").cast("double").alias("total"))
    parts = running(pixels.where("v > 0"), F.col("y") * width + F.col("x"), "v", "upto").crossJoin(F.broadcast(total)).withColumnsRenamed({"x": "px", "y": "py"})
    parts = parts.withColumns({"before": (F.col("upto") - F.col("v")).cast("double"), "cdf": F.col("upto") / F.col("total")})
    got = inverse_cdf(draws, parts, u1, low=F.col("before") / F.col("total"))
    got = got.withColumn("x", F.col("px") + (F.col(u1) * F.col("total") - F.col("before")) / F.col("v")).withColumn("y", F.col("py") + F.col(u2))
    return got.where(G.inside(domain, F.col("x"), F.col("y"))).select(*draws.columns, "x", "y")
