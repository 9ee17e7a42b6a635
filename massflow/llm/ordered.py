"""Rows in an order within groups of any size: places, running aggregates, digests.

Rows are dealt to tasks by ranges of (group, order), so a group that holds a large
part of all rows lies in many tasks. What is summed up before a row is what its own
task has before it and what earlier tasks have of its group; of these only one group
a task began earlier, so that table has no more rows than there are tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.llm.common import bounded_batches, stored

#: Grows along the order; its upper bits number the tasks' ranges.
PLACE = "__place"
#: For each way to sum up: Spark's aggregate, and what joins two of its results.
WAYS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)), "max": (F.max, F.greatest)}


def _piece() -> Column:
    return F.shiftright(F.col(PLACE), 33)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on ``keys`` in which null meets null; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(other, met, how).drop(*(f"__{k}" for k in keys))


def ordered(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``rows`` with PLACE, stored in the order of ``by`` (the group first); rows that agree in it are dealt out evenly."""
    tie = "__tie"
    order = [*(c.asc_nulls_first() for c in by), F.col(tie)]
    ranged = rows.withColumn(tie, F.rand(17)).repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
    return stored(ranged.withColumn(PLACE, F.monotonically_increasing_id()), "ordered")


def running(rows: DataFrame, key: list[str], **sums: tuple[str, Column]) -> DataFrame:
    """``rows`` of :func:`ordered` with, for each name, the aggregate (way, expression) over the rows of their group that go before them.

    Before the first row a sum and an xor are 0 and a maximum is null.
    """
    made = rows.withColumns({f"__{n}": e for n, (_, e) in sums.items()})
    here = Window.partitionBy(*key, _piece()).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = made.groupBy(*key, _piece().alias("__piece")).agg(*(WAYS[way][0](f"__{n}").alias(f"__{n}") for n, (way, _) in sums.items()))
    starts = pieces.select(*key, "__piece", F.count("*").over(earlier).alias("__n"), *(WAYS[way][0](f"__{n}").over(earlier).alias(f"__from_{n}") for n, (way, _) in sums.items())).where("__n > 0").drop("__n")
    local = made.select(*rows.columns, _piece().alias("__piece"), *(WAYS[way][0](f"__{n}").over(here).alias(f"__{n}") for n, (way, _) in sums.items()))
    both = matched(local, F.broadcast(starts), [*key, "__piece"])

    def total(n: str, way: str) -> Column:
        a, b = F.col(f"__from_{n}"), F.col(f"__{n}")
        return F.greatest(a, b) if way == "max" else WAYS[way][1](F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))

    return both.select(*rows.columns, *(total(n, way).alias(n) for n, (way, _) in sums.items()))


def folded(rows: DataFrame, key: list[str], order: list[str], sums: list[str], texts: list[str], sep: str = "") -> DataFrame:
    """Per key: the sums of whole numbers, and for each of ``texts`` the SHA-256 (lowercase hex) of its values joined by
    ``sep`` in the order. A group's rows are sorted by Spark and pass by as a stream, so memory doesn't follow the group."""
    spark = rows.sparkSession
    bounded_batches(spark)
    out = T.StructType([*(rows.schema[k] for k in key), *(T.StructField(s, T.LongType()) for s in sums), *(T.StructField(t, T.StringType()) for t in texts)])
    gap = sep.encode()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark.sql.pandas.types as types

        schema, now, state, done = types.to_arrow_schema(out), None, None, []
        result = lambda: dict(zip([f.name for f in out], [*now, *state[0], *(h.hexdigest() for h in state[1])], strict=True))
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*key, *sums, *texts)]
            for row in zip(*columns, strict=True):
                group = row[: len(key)]
                fresh = state is None or group != now
                if fresh:
                    if state is not None:
                        done.append(result())
                    now, state = group, ([0] * len(sums), [hashlib.sha256() for _ in texts])
                for i, v in enumerate(row[len(key) : len(key) + len(sums)]):
                    state[0][i] += v
                for h, t in zip(state[1], row[len(key) + len(sums) :], strict=True):
                    h.update(t.encode() if fresh else gap + t.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([result()], schema=schema)

    lines = rows.select(*key, *order, *sums, *texts).repartition(*key).sortWithinPartitions(*key, *order)
    return lines.mapInArrow(fold, out)
