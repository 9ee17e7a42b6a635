"""The planar measures that the queries work on, derived from the given tables.

The domain is D = [0, 49] x [0, 10], counter-clockwise. Every table grows with
the table it is derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAIN = [(0.0, 0.0), (49.0, 0.0), (49.0, 10.0), (0.0, 10.0)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_total(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with global aggregates in each row: one row of totals is broadcast, where a
    window over everything would gather all rows in one task."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in totals.items()))))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px(x, y, v): an 8-bit raster of 50 x 11 pixels; a missing pixel is 0."""
    n = read(spark, sf_dir, "lineitem").groupBy((F.col("l_quantity").cast("int") - 1).alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y")).agg(F.count("*").alias("n"))
    return with_total(n, top=F.max("n")).select("x", "y", F.floor(F.lit(255e0) * F.col("n") / F.col("top")).cast("int").alias("v"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site(site_id, x, y, m, w): Dirac masses of total 1 at distinct places, with weights."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") + 1001e0).alias("raw"))
    k = F.col("s_suppkey")
    return with_total(s, total=F.sum("raw")).select(
        k.cast("long").alias("site_id"),
        (F.lit(49e0) * ((k * 37) % 101) / 101).alias("x"),
        (F.lit(10e0) * ((k * 53 + 11) % 97) / 97).alias("y"),
        (F.col("raw") / F.col("total")).alias("m"),
        (F.lit(1e0) * (k % 3)).alias("w"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt(pid, x, y, m): a large discrete measure of total 1."""
    e = read(spark, sf_dir, "events").select("event_id", "value", "ts")
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return with_total(e, n=F.count("*")).select(
        F.col("event_id").cast("long").alias("pid"), (F.lit(49e0) * F.least("value", F.lit(500e0)) / 500).alias("x"), (F.lit(10e0) * clock / 86400).alias("y"), (F.lit(1e0) / F.col("n")).alias("m")
    )


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rect(rect_id, x0, y0, x1, y1): an axis-aligned rectangle by each site, within the domain."""
    k = F.col("site_id")
    s = sites(spark, sf_dir).select(k.alias("rect_id"), "x", "y", (1.3 + 0.7 * (k % 5)).alias("dx"), (0.6 + 0.45 * (k % 4)).alias("dy"))
    return s.select("rect_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.least(F.col("x") + F.col("dx"), F.lit(49e0)).alias("x1"), F.least(F.col("y") + F.col("dy"), F.lit(10e0)).alias("y1")).where("x1 > x0 and y1 > y0")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly(poly_id, vs): a counter-clockwise convex polygon by each site, a triangle or a
    quadrilateral, as an array of (x, y)."""
    k, x, y = F.col("site_id"), F.col("x"), F.col("y")
    vertex = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    wide, high = 2.1 + 0.7 * (k % 5), 1.2 + 0.4 * (k % 3)
    three = F.array(vertex(F.lit(0e0), F.lit(0e0)), vertex(wide, F.lit(0.3)), vertex(F.lit(1.1), high))
    four = F.array(vertex(F.lit(0e0), F.lit(0e0)), vertex(wide, F.lit(0.3)), vertex(wide - 0.4, high), vertex(F.lit(0.2), high - 0.1))
    return sites(spark, sf_dir).select(k.alias("poly_id"), F.when(k % 3 == 0, three).otherwise(four).alias("vs"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg(seg_id, x0, y0, x1, y1): a segment from each site to another place of the domain."""
    k = F.col("site_id")
    return sites(spark, sf_dir).select(k.alias("seg_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.lit(49e0) * ((k * 29 + 7) % 103) / 103).alias("x1"), (F.lit(10e0) * ((k * 17 + 3) % 89) / 89).alias("y1"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hier(level, site_id, x, y, m, parent_id): supplier, nation, region; level 0 is the finest."""
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("site_id"), F.col("s_nationkey").alias("n_nationkey"))
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    b = sites(spark, sf_dir).join(supplier, "site_id").join(nation, "n_nationkey")

    def level(n: int, own: str, parent: Column) -> DataFrame:
        m, centre = F.sum("m"), lambda c: F.sum(F.col("m") * F.col(c)) / F.sum("m")
        g = b.groupBy(F.col(own).cast("long").alias("site_id"), parent.cast("long").alias("parent_id")).agg(centre("x").alias("x"), centre("y").alias("y"), m.alias("m"))
        return g.select(F.lit(n).alias("level"), "site_id", "x", "y", "m", "parent_id")

    finest = b.select(F.lit(0).alias("level"), "site_id", "x", "y", "m", F.col("n_nationkey").cast("long").alias("parent_id"))
    return finest.unionByName(level(1, "n_nationkey", F.col("n_regionkey"))).unionByName(level(2, "n_regionkey", F.lit(None)))


def uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uni(k, u1, u2): numbers strictly between 0 and 1 that follow from the key alone."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.cast("long").alias("k"), (((k * 7919) % 2003 + 1) / 2004e0).alias("u1"), (((k * 104729) % 1999 + 1) / 2000e0).alias("u2"))


#: The same tables in DuckDB SQL.
SQL = {
    "px": "px AS (SELECT x, y, CAST(floor(255e0 * n / (max(n) OVER ())) AS INT) AS v FROM (SELECT CAST(l_quantity AS INT) - 1 AS x, CAST(round(l_discount * 100) AS INT) AS y, count(*) AS n FROM lineitem GROUP BY ALL) g)",
    "site": "site AS MATERIALIZED (SELECT CAST(s_suppkey AS BIGINT) AS site_id, 49e0 * ((s_suppkey * 37) % 101) / 101 AS x, 10e0 * ((s_suppkey * 53 + 11) % 97) / 97 AS y, (s_acctbal + 1001e0) / (sum(s_acctbal + 1001e0) OVER ()) AS m, 1e0 * (s_suppkey % 3) AS w FROM supplier)",
    "pt": "pt AS (SELECT CAST(event_id AS BIGINT) AS pid, 49e0 * least(value, 500e0) / 500 AS x, 10e0 * (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400 AS y, 1e0 / (count(*) OVER ()) AS m FROM events)",
    "rect": "rect AS (SELECT * FROM (SELECT site_id AS rect_id, x AS x0, y AS y0, least(x + (1.3e0 + 0.7e0 * (site_id % 5)), 49e0) AS x1, least(y + (0.6e0 + 0.45e0 * (site_id % 4)), 10e0) AS y1 FROM site) r WHERE x1 > x0 AND y1 > y0)",
    "poly": """poly AS (SELECT site_id AS poly_id, CASE WHEN site_id % 3 = 0 THEN [{'x': x, 'y': y}, {'x': x + wide, 'y': y + 0.3e0}, {'x': x + 1.1e0, 'y': y + high}]
      ELSE [{'x': x, 'y': y}, {'x': x + wide, 'y': y + 0.3e0}, {'x': x + (wide - 0.4e0), 'y': y + high}, {'x': x + 0.2e0, 'y': y + (high - 0.1e0)}] END AS vs
      FROM (SELECT *, 2.1e0 + 0.7e0 * (site_id % 5) AS wide, 1.2e0 + 0.4e0 * (site_id % 3) AS high FROM site) z)""",
    "edge": "edge AS (SELECT poly_id, i, vs[i].x AS x, vs[i].y AS y, vs[i % len(vs) + 1].x AS nx, vs[i % len(vs) + 1].y AS ny FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM poly) z)",
    "seg": "seg AS (SELECT site_id AS seg_id, x AS x0, y AS y0, 49e0 * ((site_id * 29 + 7) % 103) / 103 AS x1, 10e0 * ((site_id * 17 + 3) % 89) / 89 AS y1 FROM site)",
    "hier": """hier AS (WITH b AS (SELECT s.site_id, s.x, s.y, s.m, n.n_nationkey AS nk, n.n_regionkey AS rk FROM site s JOIN supplier u ON u.s_suppkey = s.site_id JOIN nation n ON n.n_nationkey = u.s_nationkey)
      SELECT 0 AS level, CAST(site_id AS BIGINT) AS site_id, x, y, m, CAST(nk AS BIGINT) AS parent_id FROM b
      UNION ALL SELECT 1, CAST(nk AS BIGINT), sum(m * x) / sum(m), sum(m * y) / sum(m), sum(m), CAST(rk AS BIGINT) FROM b GROUP BY nk, rk
      UNION ALL SELECT 2, CAST(rk AS BIGINT), sum(m * x) / sum(m), sum(m * y) / sum(m), sum(m), CAST(NULL AS BIGINT) FROM b GROUP BY rk)""",
    "uni": "uni AS (SELECT CAST(p_partkey AS BIGINT) AS k, (((p_partkey * 7919) % 2003) + 1) / 2004e0 AS u1, (((p_partkey * 104729) % 1999) + 1) / 2000e0 AS u2 FROM part)",
}
NEEDS = {"rect": ["site"], "poly": ["site"], "edge": ["site", "poly"], "seg": ["site"], "hier": ["site"]}


def with_tables(names: str, query: str) -> str:
    """``query`` after the definitions of the named tables and what they need."""
    order: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    return "WITH " + ",\n".join(SQL[n] for n in order) + ("," if query.lstrip().startswith(",") else "") + "\n" + query.lstrip().removeprefix(",")
