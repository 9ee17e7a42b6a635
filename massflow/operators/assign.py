"""Assignment of points to the site of their Voronoi or power cell.

The plane is cut by a quadtree over the sites: a square with more than ``LEAF`` sites is split
into sixteen, so squares are small where sites are dense. Each square of the cut lists the sites
that may be the nearest of any of its points. Power distances to two sites differ by an affine
function, so a site that is further away than another at the four corners of a square is never
the nearest in it. The lists are found from the root down, a level a round: a square passes the
nodes of the tree that may hold a nearest site on to its parts, nodes are replaced by their
children in an equi-join, and those that some site beats at all corners go. A square whose list
stays long, as beside a cluster that it sees from all sides, is split too. So the lists grow
with sites and squares however the sites lie.

A point finds its square in small directories (one level for most, further ones only where
sites are dense), meets its list in an equi-join and takes the least in the row itself, so
points are not multiplied. Of coincident sites only the one that wins anywhere is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massflow.sources.store import stored

#: Sites that every point is held against, as one list without squares.
FEW = 64
#: Sites in a square that isn't split.
LEAF = 8
#: Halvings of a side that make a level: a square is split into 4 x 4.
BITS = 2
#: Most levels.
DEEPEST = 13
#: Sites in a list above which a square is split though it holds few sites itself.
LONG = 64
#: Rounds between two stored tables of the descent.
STRIDE = 3
KEY = ["k", "qx", "qy"]
ENDS, INNER = (0.0, 1.0), (0.0, 0.5, 1.0)
CORNERS = [(u, v) for u in ENDS for v in ENDS]
#: Nine places of a square, its corners first.
PLACES = CORNERS + [(u, v) for u in INNER for v in INNER if (u, v) not in CORNERS]


@dataclass
class Box:
    """A square about points and sites, split ``depth`` times at most; squares of level k are ``side / 4 ** k`` wide."""

    x0: float
    y0: float
    side: float
    depth: int
    slack: float

    def index(self, c: str, level: Column | int = DEEPEST) -> Column:
        """The column or row of the level in which ``c`` ("x" or "y") lies."""
        across = 1 << BITS * DEEPEST
        place = F.floor((F.col(c) - F.lit(self.x0 if c == "x" else self.y0)) / F.lit(self.side) * across)
        fine = F.greatest(F.lit(0), F.least(F.lit(across - 1), place)).cast("int")
        return F.call_function("shiftright", fine, (F.lit(DEEPEST) - level) * BITS)

    def places(self) -> list[tuple[Column, Column]]:
        """The places of the square (k, qx, qy)."""
        wide = F.lit(self.side) / F.expr(f"shiftleft(1L, {BITS} * k)")
        return [(F.lit(self.x0) + wide * (F.col("qx") + u), F.lit(self.y0) + wide * (F.col("qy") + v)) for u, v in PLACES]


def _box(points: DataFrame, sites: DataFrame) -> tuple[Box, int] | None:
    """The square about both, with the level at which no square holds more than LEAF sites, and the number of sites; None where either has no rows."""
    both = points.select("x", "y", F.lit(0e0).alias("w"), F.lit(0).alias("n")).unionByName(sites.select("x", "y", "w", F.lit(1).alias("n")))
    edges = (f(c).alias(n + c) for n, f in (("low", F.min), ("high", F.max)) for c in "xy")
    e = both.agg(*edges, F.max(F.abs("w")).alias("w"), F.sum("n").alias("n"), F.count("*").alias("all")).first()
    if not e["n"] or e["all"] == e["n"]:
        return None
    low, high = [e["lowx"], e["lowy"]], [e["highx"], e["highy"]]
    side = max(high[0] - low[0], high[1] - low[1]) or 1.0
    # more than rounding takes from power distances within the box
    box = Box(*low, side, DEEPEST, 1e-13 * (side * max(side, *map(abs, low + high)) + e["w"]))
    full = _levels(sites, box).groupBy(*KEY).count().where(F.col("count") > LEAF).agg(F.max("k")).first()[0]
    box.depth = min(DEEPEST, 0 if full is None else full + 1)
    return box, e["n"]


def _levels(sites: DataFrame, box: Box) -> DataFrame:
    """The sites with the squares (k, qx, qy) of every level that they lie in."""
    at = sites.select("*", F.explode(F.sequence(F.lit(0), F.lit(box.depth))).alias("k"))
    return at.withColumns({"qx": box.index("x", F.col("k")), "qy": box.index("y", F.col("k"))})


def _even(n: int) -> int:
    """The first level with at least as many squares as sites."""
    return max(0, math.ceil(math.log2(max(1, n)) / 2 / BITS))


def _parent(c: str) -> Column:
    return F.expr(f"shiftright({c}, {BITS})")


def _tree(sites: DataFrame, box: Box) -> tuple[DataFrame, DataFrame]:
    """(k, qx, qy, node) of each square with sites whose parent is split, and (k, qx, qy, s), the sites of those that aren't."""
    at = _levels(sites, box)
    split = (F.count("*") > LEAF) & (F.col("k") < box.depth)
    edges = (f(c).alias(c + e) for c in "xy" for e, f in (("0", F.min), ("1", F.max)))
    grown = at.groupBy(*KEY).agg(split.alias("split"), *edges, F.max("w").alias("top"), F.min_by(F.struct("x", "y", "w"), F.struct(-F.col("w"), "site_id")).alias("rep"))
    parents = grown.where("split").select((F.col("k") + 1).alias("k"), F.col("qx").alias("px"), F.col("qy").alias("py"))
    under = grown.withColumns({"px": _parent("qx"), "py": _parent("qy")}).join(parents, ["k", "px", "py"], "left_semi").select(*grown.columns)
    nodes = stored(under.unionByName(grown.where("k = 0")).select(*KEY, F.struct(*grown.columns).alias("node")), "nodes")
    return nodes, at.join(nodes.where("not node.split").select(*KEY), KEY).select(*KEY, F.struct("site_id", "x", "y", "w").alias("s"))


def _unbeaten(near: DataFrame, c: str, box: Box, least, most) -> DataFrame:
    """``near`` (k, qx, qy, c) without what another row of its square beats at all corners.

    ``least`` is a lower bound of the power distances of what ``c`` holds to a place, ``most`` the
    distance to one of its sites. Rows are held against those that are the nearest to one of nine places.
    """
    places = box.places()
    lo = F.array(*(least(F.col(c), x, y) for x, y in places[: len(CORNERS)]))
    bounds = near.select(*KEY, c, lo.alias("lo"), F.array(*(most(F.col(c), x, y) for x, y in places)).alias("hi"))
    own = Window.partitionBy(*KEY)
    best = F.array(*(F.min(F.struct(F.col("hi")[i].alias("d"), F.slice("hi", 1, len(CORNERS)).alias("hi"))).over(own) for i in range(len(places))))
    beaten = F.exists("best", lambda b: reduce(and_, (b["hi"][i] < F.col("lo")[i] - F.lit(box.slack) for i in range(len(CORNERS)))))
    return bounds.withColumn("best", best).where(~beaten).select(*KEY, c)


def _power(s: Column, x: Column, y: Column) -> Column:
    return (x - s["x"]) * (x - s["x"]) + (y - s["y"]) * (y - s["y"]) - s["w"]


def _gap(n: Column, x: Column, y: Column) -> Column:
    away = lambda u, at: F.greatest(n[u + "0"] - at, at - n[u + "1"], F.lit(0e0))
    return away("x", x) * away("x", x) + away("y", y) * away("y", y) - n["top"]


def _lists(sites: DataFrame, box: Box) -> tuple[DataFrame, int]:
    """(k, qx, qy, near): the squares that share out the box, with what may be nearest to a point in them; and their deepest level."""
    nodes, held = _tree(sites, box)
    split = nodes.where("node.split").select(*KEY, F.lit(True).alias("split"))
    children = nodes.where("k > 0").select((F.col("k") - 1).alias("nk"), _parent("qx").alias("nx"), _parent("qy").alias("ny"), F.col("node").alias("child"))
    named = lambda near: near.withColumns({"nk": F.col("node.k"), "nx": F.col("node.qx"), "ny": F.col("node.qy")})
    near = nodes.where("k = 0").select(*KEY, "node")
    for level in range(box.depth):
        each = named(near).join(children.where(F.col("nk") == level), ["nk", "nx", "ny"], "left").select(*KEY, F.coalesce("child", "node").alias("node"))
        each = each.join(split.where(F.col("k") == level), KEY, "left")
        near = _unbeaten(_parts(each, "node"), "node", box, _gap, lambda n, x, y: _power(n["rep"], x, y))
        if level % STRIDE == STRIDE - 1:
            near = stored(near, "near")
    each = named(near).join(held.toDF("nk", "nx", "ny", "s"), ["nk", "nx", "ny"]).select(*KEY, "s")
    gathered = lambda each: stored(_unbeaten(each, "s", box, _power, _power).groupBy(*KEY).agg(F.collect_list("s").alias("near")), "lists")
    lists, last, long = gathered(each), box.depth, (F.size("near") > LONG) & (F.col("k") < DEEPEST)
    while lists.where(long).limit(1).count():  # squares beside a cluster, which see it from all sides
        parts = lists.where(long).select(*KEY, F.explode("near").alias("s"), F.lit(True).alias("split"))
        lists, last = stored(lists.where(~long).unionByName(gathered(_parts(parts, "s"))), "lists"), min(DEEPEST, last + 1)
    return lists, last


def _parts(each: DataFrame, c: str) -> DataFrame:
    """(k, qx, qy, c), where ``split`` once for each part of the square."""
    run = lambda c: F.explode(F.when(F.col("split"), F.sequence(F.shiftleft(c, BITS), F.shiftleft(c, BITS) + ((1 << BITS) - 1))).otherwise(F.array(c)))
    each = each.select("k", run("qx").alias("qx"), "qy", c, "split").select("k", "qx", run("qy").alias("qy"), c, "split")
    return each.select(F.when(F.col("split"), F.col("k") + 1).otherwise(F.col("k")).alias("k"), "qx", "qy", c)


def _in_squares(points: DataFrame, squares: DataFrame, box: Box, n: int, last: int) -> DataFrame:
    """``points`` with the square (k, qx, qy) of ``squares`` in which each lies.

    A directory tells the squares of a level which square of the cut they lie in; what is cut
    further is looked up in the next one. The first one has about as many squares as there are sites.
    """
    found = points.withColumn("k", F.lit(None).cast("int"))
    above, level = -1, min(last, _even(n))
    while True:
        wide = F.expr(f"shiftleft(1, {BITS} * ({level} - k))")
        part = squares.where((F.col("k") > above) & (F.col("k") <= level))
        run = lambda c: F.explode(F.sequence(F.col(c) * wide, F.col(c) * wide + wide - 1))
        told = part.select(F.col("k").alias("told"), "qx", "qy", "k").select("told", run("qx").alias("tx"), "qy", "k").select("told", "tx", run("qy").alias("ty"))
        keys = {"t" + c: F.when(F.col("k").isNull(), box.index(c, level)) for c in "xy"}
        found = found.withColumns(keys).join(told, ["tx", "ty"], "left").withColumn("k", F.coalesce("k", "told")).drop("tx", "ty", "told")
        if level >= last:
            return found.withColumns({"qx": box.index("x", F.col("k")), "qy": box.index("y", F.col("k"))})
        above, level = level, level + 1


def assigned(points: DataFrame, sites: DataFrame, weighted: bool = True) -> DataFrame:
    """``points`` (x, y, ...) with site_id and d2, the squared distance to the site.

    The site is the one with the least ``d2 - w`` (``d2`` if not ``weighted``); of
    equal ones the smallest site_id. Points and sites with a null place are left out,
    as are sites with a null weight; without sites there are no rows.
    """
    s = sites.select("site_id", "x", "y", (F.col("w") if weighted else F.lit(0e0)).alias("w")).where("x is not null and y is not null and w is not null")
    found = s.select(F.struct("site_id", "x", "y", "w").alias("s")).limit(FEW + 1).agg(F.collect_list("s").alias("near"))
    few = 0 < found.select(F.size("near")).first()[0] <= FEW
    points = points.where("x is not null and y is not null")
    if not few:
        s = stored(s.groupBy("x", "y").agg(F.min(F.struct((-F.col("w")).alias("lift"), "site_id", "w")).alias("s")).select("s.site_id", "x", "y", "s.w"), "sites")
    about = None if few else _box(points, s)
    if not few and about is None:
        return points.select("*", F.lit(None).cast("long").alias("site_id"), F.lit(None).cast("double").alias("d2")).limit(0)
    x, y = F.col("x"), F.col("y")
    d2 = lambda s: (x - s["x"]) * (x - s["x"]) + (y - s["y"]) * (y - s["y"])
    best = F.array_min(F.transform("near", lambda s: F.struct((d2(s) - s["w"]).alias("power"), s["site_id"].alias("site_id"), d2(s).alias("d2"))))
    if few:
        met = points.crossJoin(F.broadcast(found))
    else:
        box, n = about
        lists, last = _lists(s, box)
        own = points.select(F.struct(*points.columns).alias("own"), "x", "y")  # their columns may be named as the squares' are
        met = _in_squares(own, lists.select(*KEY), box, n, last).join(lists, KEY)
        return met.withColumn("best", best).select("own.*", F.col("best.site_id").alias("site_id"), F.col("best.d2").alias("d2"))
    return met.withColumn("best", best).where("best is not null").select(*points.columns, F.col("best.site_id").alias("site_id"), F.col("best.d2").alias("d2"))


def cell_masses(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site, also the empty ones: mu (mass of its power cell), sqint (integral of the
    squared distance) and g = mu - m, the gradient of the transport objective."""
    got = assigned(points, sites).groupBy("site_id").agg(F.sum("m").alias("mu"), F.sum(F.col("m") * F.col("d2")).alias("sqint"))
    both = sites.join(got, "site_id", "left")
    mu = F.coalesce("mu", F.lit(0e0))
    return both.select("site_id", "x", "y", "m", "w", mu.alias("mu"), F.coalesce("sqint", F.lit(0e0)).alias("sqint"), (mu - F.col("m")).alias("g"))
