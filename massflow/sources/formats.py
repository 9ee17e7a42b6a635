"""Readers and writers of the library's text, image and table formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLY = "poly_id string, vs array<struct<x:double,y:double>>"


def _numbers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines of numbers between blanks; blank lines and lines that begin with # are passed over."""
    parts = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("p"))
    parts = parts.where("size(p) > 0 and p[0] <> '' and not startswith(p[0], '#')")
    return parts.select("file", "line", *(F.get("p", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)))


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(poly_id, vs): a polygon per file, a vertex ``x y`` per line, counter-clockwise."""
    vertices = F.sort_array(F.collect_list(F.struct("line", "x", "y")))
    g = _numbers(spark, path, ["x", "y"]).groupBy(F.col("file").alias("poly_id")).agg(vertices.alias("v"))
    return g.select("poly_id", F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vs"))


def read_diracs(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, x, y, m): a Dirac mass ``x y m`` per line; site_id follows the order of lines."""
    return _numbers(spark, path, ["x", "y", "m"]).select(F.col("line").alias("site_id"), "x", "y", "m")


def read_weighted_points(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, x, y, w): a weighted point ``x y w`` per line."""
    return _numbers(spark, path, ["x", "y", "w"]).select(F.col("line").alias("site_id"), "x", "y", "w")


def read_image(spark: SparkSession, path: str, invert: bool = False) -> DataFrame:
    """(path, x, y, v): the pixels of images as gray levels, (0, 0) at the lower left.

    PNG, JPEG and BMP files go through Spark's image source; PGM files are decoded here.
    """
    v = (lambda c: 255 - c) if invert else (lambda c: c)
    if path.lower().endswith(".pgm"):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_pgm, "path string, x int, y int, v int").withColumn("v", v(F.col("v")))
    raw = spark.read.format("image").load(path).select("image.*")
    return raw.mapInPandas(_decoded, "path string, x int, y int, v int").withColumn("v", v(F.col("v")))


def _rows(path: str, gray: np.ndarray) -> pd.DataFrame:
    h, w = gray.shape
    x, y = np.meshgrid(np.arange(w, dtype=np.int32), np.arange(h - 1, -1, -1, dtype=np.int32))
    return pd.DataFrame({"path": path, "x": x.ravel(), "y": y.ravel(), "v": gray.astype(np.int32).ravel()})


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.width > 0:
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                yield _rows(r.origin, a[:, :, 0] if r.nChannels == 1 else a[:, :, :3].mean(axis=2))


def _pgm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            at, fields = 0, []
            while len(fields) < 4:  # kind, width, height, greatest value
                while content[at : at + 1].isspace():
                    at += 1
                if content[at : at + 1] == b"#":
                    at = content.index(b"\n", at)
                    continue
                end = at
                while not content[end : end + 1].isspace():
                    end += 1
                fields.append(content[at:end])
                at = end
            w, h = int(fields[1]), int(fields[2])
            body = np.frombuffer(content[at + 1 :], dtype=np.uint8)[: w * h] if fields[0] == b"P5" else np.array(content[at:].split(), dtype=np.uint8)
            yield _rows(path, body.reshape(h, w))


READERS: dict[str, Callable[..., DataFrame]] = {".poly": read_poly, ".diracs": read_diracs, ".pts": read_weighted_points}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A source by its suffix; what isn't a text format is an image."""
    return next((r for suffix, r in READERS.items() if path.lower().endswith(suffix)), read_image)(spark, path)


def write_hierarchy(hier: DataFrame, path: str) -> None:
    hier.write.partitionBy("level").parquet(path)


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """A written hierarchy; masses are of total 1 at each level again."""
    h = spark.read.parquet(path)
    total = h.groupBy("level").agg(F.sum("m").alias("__total"))
    return h.join(F.broadcast(total), "level").withColumn("m", F.col("m") / F.col("__total")).select("level", "site_id", "x", "y", "m", "parent_id")


def write_dec(hier: DataFrame, path: str) -> None:
    """One text file: the number of levels, then from the coarsest level on its number of sites and ``x y m`` lines.

    A hierarchy's export for other programs, which read it from one file.
    """
    line = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"), F.col("m").cast("string"))
    counts = hier.groupBy("level").agg(F.count("*").cast("string").alias("value"))
    head = hier.agg(F.countDistinct("level").cast("string").alias("value")).select(F.lit(1 << 30).alias("level"), F.lit(-2).cast("long").alias("k"), "value")
    rows = head.unionByName(counts.select("level", F.lit(-1).cast("long").alias("k"), "value")).unionByName(hier.select("level", F.col("site_id").alias("k"), line.alias("value")))
    rows.orderBy(F.desc("level"), "k").coalesce(1).select("value").write.text(path)


def write_points(sites: DataFrame, path: str, *columns: str) -> None:
    """``columns`` of sites between blanks, a site per line."""
    sites.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


LOG_COLUMNS = {"iteration": "iteration", "value": "f", "ginf": "ginf", "g1": "g1", "active": "active", "w": "w"}


def log_lines(log: DataFrame, flags: str = "iteration|value|ginf") -> DataFrame:
    """(iteration, line): the columns of an iteration log that ``flags`` names, between blanks."""
    wanted = flags.split("|")
    if unknown := [f for f in wanted if f not in LOG_COLUMNS]:
        raise ValueError(f"no such log columns: {unknown}")
    return log.select("iteration", F.concat_ws(" ", *(F.col(c).cast("string") for f, c in LOG_COLUMNS.items() if f in wanted)).alias("line"))
