"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massflow.llm.common import stored


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every end of ``links`` (x, y long) that has a link with another: the smallest number that can be reached.

    The links are contracted: in a round, each end moves to the first of itself
    and its neighbours, in the order of a hash that each round takes anew (the
    first round takes the order of the numbers, which settles stars), and on to where
    the one that it moves to goes, twice; links are then drawn between the places
    moved to. Along a path about a third of the ends is expected to be left by a
    round, so the rounds grow with the logarithm of the longest chain, however it is
    numbered, and the links shrink all along.
    """
    edges, moves = stored(_edges(links), "edges"), []
    while not moves or not edges.isEmpty():
        salt = F.lit(len(moves))

        def place(c: str, salt=salt) -> Column:
            return F.struct((F.xxhash64(salt, F.col(c)) if moves else F.col(c)).alias("order"), F.col(c).alias("at"))

        both = edges.select(F.col("x").alias("v"), F.col("y").alias("u")).unionByName(edges.select(F.col("y").alias("v"), F.col("x").alias("u")))
        near = both.groupBy("v").agg(F.min(place("u")).alias("first"))
        to = stored(near.select("v", F.when(place("v") < F.col("first"), F.col("v")).otherwise(F.col("first.at")).alias("w")), "moves")
        further = to.select(F.col("v").alias("w"), F.col("w").alias("next"))
        for _ in range(2):
            to = to.join(further, "w", "left").select("v", F.coalesce("next", "w").alias("w"))
        at = lambda c, to=to: to.select(F.col("v").alias(c), F.col("w").alias(f"{c}w"))
        edges = stored(_edges(edges.join(at("x"), "x").join(at("y"), "y").select(F.col("xw").alias("x"), F.col("yw").alias("y"))), "edges")
        moves.append(to)
    ends = moves.pop()
    while moves:
        further = ends.select(F.col("v").alias("w"), F.col("w").alias("end"))
        ends = moves.pop().join(further, "w", "left").select("v", F.coalesce("end", "w").alias("w"))
    ends = stored(ends, "ends")
    return ends.join(ends.groupBy("w").agg(F.min("v").alias("label")), "w").select("v", "label")
