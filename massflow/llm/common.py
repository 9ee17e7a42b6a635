"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]+"

#: Most rows and bytes of whole texts that go to Python at once; no text is cut.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it names smaller ones.

    Spark's 10,000 rows would let a task's memory, in the JVM and in Python,
    follow the length of the texts.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in a local session that names none, as in tests, a temporary folder of
    this machine is set; on a cluster the executors could not share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage and fixes every value that a recomputation could
    give anew, so a lost executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_id() -> Column:
    """A number for each row of a scan; fix it with :func:`stored` before use."""
    return F.monotonically_increasing_id()


def loose(key: Column) -> Column:
    """``key`` unchanged, but as an expression whose partitioning Spark doesn't know.

    A join on it shuffles both sides by itself, and only then may the adaptive
    planner split a partition that one hot key has made too large.
    """
    return key.bitwiseXOR(F.lit(0x5851F42D4C957F2D))


#: The column of numbered_rows.
ROW = "__row"


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW, a number for each row, stored: a later scan sees the same rows and numbers."""
    return stored(docs.withColumn(ROW, row_id()), "numbered")


def without_rows(whole: DataFrame, gone: DataFrame) -> DataFrame:
    """``whole``, of numbered_rows, without the rows that ``gone`` names in ``rid``; ROW is taken off."""
    return whole.join(gone.select(F.col("rid").alias(ROW)), ROW, "left_anti").drop(ROW)


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` of ``rows``, those with the smallest hashes of ``key``.

    A power of two as bound on the hash, the smallest that ``n`` rows meet (or all there
    are), goes before the order, so that what one task gathers follows ``n`` and not the
    number of tasks.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    bits = F.length(F.bin(place))
    met, bound = 0, 0
    for r in sorted(rows.groupBy(bits.alias("bits")).count().collect()):  # 40 rows at most
        met, bound = met + r["count"], r["bits"]
        if met >= n:
            break
    return rows.where(bits <= bound).orderBy(place, key).limit(n)
