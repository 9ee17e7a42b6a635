"""Greedy moves of excess mass to the nearest remaining lack, in rounds over tables.

The rule is a walk: sources (g > 0) in the order of site_id each fill the nearest
sinks (g < 0) that have room left, of equally near ones the smallest site_id. Late
sources go far and depend on nearly all others, so up to ``HELD_SITES`` sinks one
task walks: the sinks come first in its one sorted stream, then the sources, which
it doesn't hold. A tree of boxes, whose full parts are passed over, gives a source
its sinks from the nearest on.

More sinks take rounds over tables first. As every sink ranks the sources by the
same order, deferred acceptance ends with the walk's moves: in each round all
sources with mass left offer it to the nearest sink that isn't closed to them; a
sink keeps its offers in the order of site_id up to its room and gives the rest
back. A full sink is open only to sources before the last that it holds, which such
a source would displace. Sources before the first with mass left are settled; as
soon as they leave room in ``HELD_SITES`` sinks at most, the rest is walked.

In a round the nearest open sink is sought down a tree of squares: a node knows the
box of its sinks and the latest source that one of them is open to, so nodes that
are closed to a source, or further away than another is at most, fall away. Each
level is one equi-join. A sink's offers are summed by ranges of sources first, so
that a sink with very many offers doesn't lie in one task.

Defined results: without sources or without sinks there are no moves; a site
without place or residual is passed over; excess beyond all room stays; masses
are counted in 1e-15 of the residuals' sum, so that results don't depend on the
order of additions, and residuals below half of that don't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massflow.operators.cells import HELD_SITES
from massflow.sources.store import stored

#: Parts that the residuals' sum is counted in.
PARTS = 1e15
#: Sinks of a leaf, bits of a level along each side, and most levels.
LEAF, BITS, DEPTH = 64, 4, 5
#: Ranges of sources, by which a sink's offers are summed first.
RANGES = 256
#: Levels whose nodes every task gets: 16 ** 2 squares, then 256 ** 2.
BROADCAST_LEVELS = 2
#: Most sinks of a leaf of the walk's tree.
BUCKET = 8
_OPEN = (1 << 63) - 1


def _square(level: int, depth: int):
    """The column that names a sink's square of a level."""
    return F.expr(f"shiftleft(cast(shiftright(ix, {BITS * (depth - level)}) as bigint), 32) + shiftright(iy, {BITS * (depth - level)})")


def _with_leaves(sinks: DataFrame) -> tuple[DataFrame, int]:
    """The sinks with their squares ix, iy at the depth at which no leaf has more than ``LEAF``."""
    box = sinks.agg(F.min("sx"), F.min("sy"), F.greatest(F.max("sx") - F.min("sx"), F.max("sy") - F.min("sy"))).first()
    side = box[2] or 1.0

    def at(depth: int) -> DataFrame:
        n = 1 << BITS * depth
        place = lambda c, low: F.least(F.lit(n - 1), F.floor((F.col(c) - low) / side * n)).cast("int")
        return sinks.withColumns({"ix": place("sx", box[0]), "iy": place("sy", box[1])})

    finest = at(DEPTH)
    every = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), _square(d, DEPTH).alias("q")) for d in range(DEPTH + 1)])).alias("e")
    full = {r["d"]: r["n"] for r in finest.select(every).groupBy("e.d", "e.q").count().groupBy("d").agg(F.max("count").alias("n")).collect()}
    depth = next((d for d in range(DEPTH) if full.get(d, 0) <= LEAF), DEPTH)
    return at(depth), depth


def _offers(seekers: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """(source, span, sink, amount, d2): what each seeker has left, offered to its nearest open sink."""
    gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0e0))
    far = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1")))
    front = seekers.withColumn("square", F.lit(0).cast("long"))
    for level in range(1, depth + 1):
        box = [f(f"s{c}").alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))]
        nodes = sinks.groupBy(_square(level - 1, depth).alias("square"), _square(level, depth).alias("next")).agg(F.max("until").alias("until"), *box)
        met = front.join(F.broadcast(nodes) if level <= BROADCAST_LEVELS else nodes, "square").where("source < until")
        met = met.withColumns({"least": gap("x") ** 2 + gap("y") ** 2, "most": far("x") ** 2 + far("y") ** 2})
        # some sink of each node is open to the source, so the nearest is no further than the least "most"
        met = met.withColumn("bound", F.min("most").over(Window.partitionBy("source")))
        front = met.where("least <= bound * (1 + 1e-9)").select(*seekers.columns, F.col("next").alias("square"))
    leaves = sinks.select(_square(depth, depth).alias("square"), "sink", "sx", "sy", "until")
    met = front.join(leaves, "square").where("source < until")
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    best = met.groupBy("source", "span").agg(F.min("left").alias("amount"), F.min(F.struct(d2.alias("d2"), F.col("sink"))).alias("best"))
    return best.select("source", "span", "best.sink", "amount", "best.d2")


class Sinks:
    """Sinks (id, x, y, room) in a binary tree of boxes, halved across their longer side, level by level.

    Node i has the nodes 2 i and 2 i + 1 below it; a sink's number is its rank by id.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, room: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        ids, x, y, room = ids[by_id], x[by_id], y[by_id], room[by_id]
        n, depth, order = len(ids), 0, np.arange(len(ids))
        while n > BUCKET << depth:
            starts = (n * np.arange(1 << depth)) >> depth
            wide, high = (np.maximum.reduceat(c[order], starts) - np.minimum.reduceat(c[order], starts) for c in (x, y))
            node = np.repeat(np.arange(1 << depth), np.diff(np.r_[starts, n]))
            order = order[np.lexsort((np.where(wide[node] >= high[node], x[order], y[order]), node))]
            depth += 1
        starts = (n * np.arange(1 << depth)) >> depth
        sides = [f.reduceat(c[order], starts) if n else np.zeros(1) for c in (x, y) for f in (np.minimum, np.maximum)]
        levels = [sides]
        for _ in range(depth):
            sides = [f(c[::2], c[1::2]) for c, f in zip(sides, (np.minimum, np.maximum) * 2, strict=True)]
            levels.append(sides)
        self.boxes = [(0.0,) * 4, *zip(*(np.concatenate(c).tolist() for c in zip(*reversed(levels), strict=True)), strict=True)]
        self.leaves = 1 << depth
        # of a leaf its sinks with room, of another node whether there is one below it
        self.open: list = [n > 0] * self.leaves + [o.tolist() for o in np.split(order, starts[1:])]
        leaf = np.empty(n, dtype=np.int64)
        leaf[order] = self.leaves + np.repeat(np.arange(self.leaves), np.diff(np.r_[starts, n]))
        self.ids, self.x, self.y, self.room, self.leaf = ids.tolist(), x.tolist(), y.tolist(), room.tolist(), leaf.tolist()

    def _close(self, sink: int) -> None:
        node = self.leaf[sink]
        self.open[node].remove(sink)
        while node > 1 and not self.open[node] and not self.open[node ^ 1]:
            node >>= 1
            self.open[node] = False

    def filled(self, x: float, y: float, left: int) -> Iterator[tuple[int, int, float]]:
        """(id, amount, d2): the sinks that a source at (x, y) fills with ``left``, from the nearest on; their rooms shrink."""
        ahead = [(0.0, -1, 1)] if self.open[1] else []  # nodes by their least distance, before sinks as near
        while left and ahead:
            d2, sink, node = heappop(ahead)
            if sink >= 0:
                amount = min(left, self.room[sink])
                left -= amount
                self.room[sink] -= amount
                if not self.room[sink]:
                    self._close(sink)
                yield self.ids[sink], amount, d2
            elif node >= self.leaves:
                for k in self.open[node]:
                    dx, dy = x - self.x[k], y - self.y[k]
                    heappush(ahead, (dx * dx + dy * dy, k, 0))
            else:
                for k in (2 * node, 2 * node + 1):
                    if self.open[k]:
                        x0, x1, y0, y1 = self.boxes[k]
                        dx = x0 - x if x < x0 else x - x1 if x > x1 else 0.0
                        dy = y0 - y if y < y0 else y - y1 if y > y1 else 0.0
                        heappush(ahead, (dx * dx + dy * dy, -1, k))


def _walked(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(source, sink, amount, d2): the walk itself, in one task that has all ``sinks`` (sink, sx, sy, room); ``sources`` (source, x, y, mass) pass by."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, places = [], None
        for batch in batches:
            before.append(batch[~batch["source"]])
            some = batch[batch["source"]]
            if not len(some):
                continue
            if places is None:
                p = pd.concat(before)
                places = Sinks(*(p[c].to_numpy() for c in ("id", "x", "y", "u")))
            rows = zip(*(some[c].tolist() for c in ("id", "x", "y", "u")), strict=True)
            yield pd.DataFrame([(i, *m) for i, x, y, u in rows for m in places.filled(x, y, u)], columns=["source", "sink", "amount", "d2"])

    rows = sinks.select(F.lit(False).alias("source"), F.col("sink").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("room").alias("u"))
    rows = rows.unionByName(sources.select(F.lit(True).alias("source"), F.col("source").alias("id"), "x", "y", F.col("mass").alias("u")))
    return rows.repartition(1).sortWithinPartitions("source", "id").mapInPandas(walk, "source long, sink long, amount long, d2 double")


def _kept(offers: DataFrame, rooms: DataFrame) -> DataFrame:
    """What sinks keep of all they hold and are offered, in the order of the sources."""
    mine = offers.groupBy("sink", "span", "source").agg(F.sum("amount").alias("amount"), F.min("d2").alias("d2"), F.max("fresh").alias("fresh"))
    sums = mine.groupBy("sink", "span").agg(F.sum("amount").alias("part"))
    earlier = Window.partitionBy("sink").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("part").over(earlier), F.lit(0))).join(rooms, "sink").where("before < room")
    inside = Window.partitionBy("sink", "span").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    both = mine.join(sums.select("sink", "span", (F.col("room") - F.col("before")).alias("room")), ["sink", "span"])
    taken = F.least(F.col("amount"), F.col("room") - F.coalesce(F.sum("amount").over(inside), F.lit(0)))
    return both.withColumn("amount", taken).where("amount > 0").select("source", "span", "sink", "amount", "d2", "fresh")


def _settled(sources: DataFrame, sinks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The moves of the first sources, the other sources, and the sinks with the room that is left to these: ``HELD_SITES`` at most, or there are no others."""
    # ends of ranges of sources: a fixed number, whatever the sources' number
    ends = sorted(set(sources.approxQuantile("source", [k / RANGES for k in range(1, RANGES)], 1 / (4 * RANGES))))
    sources = stored(sources.withColumn("span", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("source")))), "sources")
    leaves, depth = _with_leaves(sinks)
    sinks = stored(leaves, "sinks")
    rooms, held = sinks.select("sink", "room"), None
    seekers, known = sources.withColumnRenamed("mass", "left"), sinks.withColumn("until", F.lit(_OPEN))
    while True:
        offers = _offers(seekers, known, depth).withColumn("fresh", F.lit(True))
        if held is not None:
            offers = offers.unionByName(held.withColumn("fresh", F.lit(False)))
        held = stored(_kept(offers, rooms), "moves")
        given = held.groupBy("source").agg(F.sum("amount").alias("given"))
        seekers = sources.join(given, "source", "left").withColumn("left", F.col("mass") - F.coalesce("given", F.lit(0))).where("left > 0").drop("mass", "given")
        seekers = stored(seekers, "seekers")
        last = held.groupBy("sink").agg(F.sum("amount").alias("full"), F.max("source").alias("last"))
        known = sinks.join(last, "sink", "left").withColumn("until", F.when(F.col("full") >= F.col("room"), F.col("last")).otherwise(F.lit(_OPEN)))
        first = seekers.agg(F.min("source")).first()[0]
        done = first is None or held.where("fresh").isEmpty()
        before, others = (held, sources.limit(0)) if done else (held.where(F.col("source") < first), sources.where(F.col("source") >= first))
        full = before.groupBy("sink").agg(F.sum("amount").alias("full"))
        rest = sinks.join(full, "sink", "left").withColumn("room", F.col("room") - F.coalesce("full", F.lit(0))).where("room > 0")
        if done or rest.count() <= HELD_SITES:
            return before.select("source", "sink", "amount", "d2"), others, rest


def greedy_moves(stats: DataFrame) -> DataFrame:
    """(source, sink, m, d2): how the walk moves the residuals g of ``stats`` (site_id, x, y, g)."""
    sites = stored(stats.where("g <> 0 and x is not null and y is not null").select("site_id", "x", "y", "g"), "residuals")
    total = sites.agg(F.sum(F.abs("g"))).first()[0]
    nothing = sites.select(F.col("site_id").alias("source"), F.col("site_id").alias("sink"), F.col("g").alias("m"), F.col("g").alias("d2")).limit(0)
    if not total:
        return nothing
    sites = sites.withColumn("u", F.round(F.col("g") / total * PARTS).cast("long"))
    sources = sites.where("u > 0").select(F.col("site_id").alias("source"), "x", "y", F.col("u").alias("mass"))
    sinks = sites.where("u < 0").select(F.col("site_id").alias("sink"), F.col("x").alias("sx"), F.col("y").alias("sy"), (-F.col("u")).alias("room"))
    if sources.isEmpty() or sinks.isEmpty():
        return nothing
    held, sources, sinks = _settled(sources, sinks) if sinks.count() > HELD_SITES else (None, sources, sinks)
    moves = _walked(sources, sinks)
    if held is not None:
        moves = moves.unionByName(held)
    return stored(moves, "moves").select("source", "sink", (F.col("amount") * F.lit(total / PARTS)).alias("m"), "d2")


def greedy_bound(stats: DataFrame) -> float:
    """The root of the greedy moves' mass times squared way."""
    return math.sqrt(greedy_moves(stats).agg(F.sum(F.col("m") * F.col("d2"))).first()[0] or 0.0)
