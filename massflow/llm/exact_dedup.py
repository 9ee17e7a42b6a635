"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size; the distinct blocks of the corpus are
sorted and get integer names; then the names of adjacent pairs are named in
turn, halving each text's sequence, until every text has a single name. Equal
names mean equal contents, which no hash alone could promise. Only DataFrame
operations are used.

Defined results: a null text counts as empty; empty texts are equal to each
other; of equal texts the row with the smallest doc_id stays (a null doc_id
comes last), and where a doc_id repeats, the row that is read first; an empty
table gives an empty result; columns besides the two named ones pass through
``deduplicated`` and are ignored by ``exact_groups``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import ROW, WHITE_SPACE, loose, numbered_rows, row_id, stored, table, without_rows

BLOCK_BYTES = 4096
#: In a pair, the missing right half at an odd end.
NO_NAME = -1


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers the rows of ``distinct`` in the order of ``keys`` in each partition.

    The hash of its keys fixes a row's partition and the sort its place there,
    so a task that runs again gives the same names.
    """
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _hashes(block: str, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * salt + i), F.col(block)).alias(f"h{i}") for i in (0, 1)]


def _block_names(blocks: DataFrame) -> DataFrame:
    """(h0, h1, name, contents) of the distinct blocks.

    ``contents`` tells how many contents have this pair of hashes; where it is 1
    for all, a block is found by its hashes and its contents need no second
    shuffle.
    """
    named = _named(blocks.groupBy("h0", "h1", "block").agg(F.count("*").alias("n")), ["block", "h0", "h1"])
    names = stored(named.select("h0", "h1", "name"), "block-names")
    return names.groupBy("h0", "h1").agg(F.min("name").alias("name"), F.count("*").alias("contents"))


def _joined_names(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the name of their ``keys``; a hot key's rows may be split."""
    found = names.select(*(loose(F.col(k)).alias(f"_{k}") for k in keys), "name")
    on = reduce(Column.__and__, (loose(F.col(k)) == F.col(f"_{k}") for k in keys))
    return rows.join(found, on).drop(*keys, *(f"_{k}" for k in keys))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 and rid."""
    return _grouped(docs.select(row_id().alias("rid"), "doc_id", "text"), block_bytes)


def _grouped(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """exact_groups of a table (rid, doc_id, text); what is needed of it is stored with its rid."""

    def cut(b: Column) -> Column:
        last = F.greatest(F.lit(0), (F.ceil(F.length(b) / F.lit(block_bytes)) - 1).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * block_bytes + 1, F.lit(block_bytes)))

    # bound as a lambda's variable, a text is normalised and encoded once and not again for each block
    once = F.transform(
        F.array(normalised(F.col("text"))),
        lambda t: F.struct(F.unhex(F.sha2(t, 256)).alias("sha"), F.transform(F.array(F.encode(t, "UTF-8")), cut)[0].alias("blocks")),
    )
    for salt in range(8):
        blocks = docs.select(F.inline(once)).select(F.explode("blocks").alias("block")).select(*_hashes("block", salt), "block")
        names = _block_names(blocks)
        if names.where("contents > 1").isEmpty():
            break
    else:
        raise ValueError("blocks of different contents share their hashes under every salt")
    keys = (
        docs.select("rid", "doc_id", F.inline(once))
        .select("rid", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        .select("rid", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "n", "pos", *_hashes("block", salt))
    )
    parts = stored(_joined_names(keys, names, ["h0", "h1"]), "named-blocks")
    identified = [parts.where("n = 1").select("rid", "doc_id", "sha", F.lit(0).alias("level"), "name")]
    heads = parts.where("n > 1 and pos = 0").select("rid", "doc_id", "sha")
    state, level = parts.where("n > 1").select("rid", "n", "pos", "name"), 0
    longest = state.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = state.groupBy("rid", ((F.col("n") + 1) / 2).cast("int").alias("n"), (F.col("pos") / 2).cast("int").alias("pos")).agg(
            half(0).alias("left"), F.coalesce(half(1), F.lit(NO_NAME)).alias("right")
        )
        pair_names = stored(_named(pairs.groupBy("left", "right").agg(F.count("*").alias("c")), ["left", "right"]).drop("c"), "pair-names")
        parts = stored(_joined_names(pairs, pair_names, ["left", "right"]), "named-pairs")
        identified.append(parts.where("n = 1").select("rid", "name").join(heads, "rid").select("rid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        state = parts.where("n > 1")
    every = reduce(DataFrame.unionByName, identified)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    groups = every.groupBy("level", "name").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
    groups = groups.select(loose(F.col("name")).alias("_name"), F.col("level").alias("_level"), "keep", "group_size")
    return every.join(groups, (loose(F.col("name")) == F.col("_name")) & (F.col("level") == F.col("_level"))).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "rid",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept."""
    whole = numbered_rows(docs)
    return without_rows(whole, _grouped(whole.select(F.col(ROW).alias("rid"), "doc_id", "text")).where("not kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("rid")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
