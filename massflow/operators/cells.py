"""Exact Voronoi and power cells of a set of sites in a convex domain.

A cell is the domain cut by the bisectors towards the other sites, nearest first,
until no further site can cut it: one at distance d lies no nearer to the cell's
own site than (d^2 + w - w_max) / 2d. The sites lie in a grid and are visited ring
by ring, so a cell costs its neighbourhood and not all sites. A task cuts many cells at
once, as arrays.

:func:`power_cells` takes sites of any number. They are dealt into tiles of about equally
many sites, by strips of x and then by y, so clusters make small tiles and not
large ones. A task has one tile and some tiles about it, and cuts its tile's cells by
these. A tile further away can cut a cell only if its box and its heaviest site could
have a smaller power distance from one of the cell's corners than the cell's own site;
for a cell where that is so, these tiles are asked, each gives the sites of its own that
cut the cell, and the cell is cut by these. What all tasks know of all tiles is their
boxes and heaviest weights, MAX_TILES of them at most.

Solvers evaluate the same sites many times; up to HELD_SITES they send them to tasks whole
(:func:`cells_of` and the like), and beyond that they take :func:`power_cells` too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.functions import geometry as G
from massflow.functions.clip import Grid, Polygons
from massflow.sources.fixtures import DOMAIN
from massflow.sources.store import stored

#: Sites that a solver sends to every task, some 70 bytes each.
HELD_SITES = 500_000
#: Sites of a tile, tiles at most, and tiles that a task has beside its own.
TILE_SITES, MAX_TILES, BESIDE = 256, 100_000, 12
#: Requests that one task answers from a tile.
ASKED = 8192
#: Rounds of coordinate steps that a block of sites takes in a task, and the lack of mass of all that ends them.
SWEEPS, LACK = 4000, 1e-7
CELL = "site_id long, vs array<struct<x:double,y:double>>, neighbours array<long>"


#: Cells, and pairs of a site and one near it, that are worked on at a time.
CELLS, PAIRS = 2048, 1_000_000


class Sites:
    """Sites (site_id, x, y, w) in a grid of about one a square; their cells are cut for many sites at once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, domain: list[tuple[float, float]]):
        self.ids, self.x, self.y, self.w, self.domain = ids, x, y, w, domain
        n = len(ids)
        self.x0, self.y0 = (float(x.min()), float(y.min())) if n else (0.0, 0.0)
        wide, high = (float(np.ptp(x)), float(np.ptp(y))) if n else (0.0, 0.0)
        self.h = max(1e-9, math.sqrt(wide * high / max(1, n)), max(wide, high) / max(1, n))
        self.nx, self.ny = int(wide / self.h) + 1, int(high / self.h) + 1
        self.cx, self.cy = np.floor((x - self.x0) / self.h).astype(np.int64), np.floor((y - self.y0) / self.h).astype(np.int64)
        square = self.cx * self.ny + self.cy
        self.order = np.argsort(square, kind="stable")
        self.starts = np.searchsorted(square[self.order], np.arange(self.nx * self.ny + 1))
        self.rings = max(self.nx, self.ny)
        self.id_order = np.argsort(ids, kind="stable")
        self.by_id = np.argsort(self.id_order, kind="stable")
        self.w_max = float(w.max()) if n else 0.0

    @property
    def grid(self) -> dict[tuple[int, int], list[int]]:
        found: dict[tuple[int, int], list[int]] = {}
        for i, k in enumerate(zip(self.cx.tolist(), self.cy.tolist(), strict=True)):
            found.setdefault(k, []).append(i)
        return found

    def ring(self, cx: np.ndarray, cy: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place): the sites in the squares ``r`` away from each square (cx, cy)."""
        side = np.arange(-r, r + 1)
        if r:
            dx, dy = np.concatenate([side, side, np.full(2 * r - 1, -r), np.full(2 * r - 1, r)]), np.concatenate([np.full(2 * r + 1, -r), np.full(2 * r + 1, r), side[1:-1], side[1:-1]])
        else:
            dx = dy = np.zeros(1, dtype=np.int64)
        sx, sy = cx[:, None] + dx, cy[:, None] + dy
        ok = (sx >= 0) & (sx < self.nx) & (sy >= 0) & (sy < self.ny)
        row, k = np.nonzero(ok)
        q = sx[row, k] * self.ny + sy[row, k]
        first, count = self.starts[q], self.starts[q + 1] - self.starts[q]
        which = np.repeat(np.arange(len(q)), count)
        at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return row[which], self.order[at]

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the site nearest to each point, of equally near ones that with the smallest id, and the squared distance; weights don't count."""
        place, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
        cx = np.clip(np.floor((x - self.x0) / self.h), 0, self.nx - 1).astype(np.int64)
        cy = np.clip(np.floor((y - self.y0) / self.h), 0, self.ny - 1).astype(np.int64)
        going = np.arange(len(x))
        for r in range(self.rings + 1):
            if r > 1:  # sites of this ring are no nearer than that
                going = going[((r - 1) * self.h) ** 2 <= best[going] * (1 + 1e-9)]
            room = max(1, PAIRS // (8 * r + 1))
            for some in (going[k : k + room] for k in range(0, len(going), room)):
                row, j = self.ring(cx[some], cy[some], r)
                if not len(row):
                    continue
                d2 = (x[some[row]] - self.x[j]) ** 2 + (y[some[row]] - self.y[j]) ** 2
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                least = np.minimum.reduceat(d2, first)
                order = np.where(d2 == np.repeat(least, np.diff(np.r_[first, len(row)])), self.by_id[j], len(self.ids))
                order, to = np.minimum.reduceat(order, first), some[row[first]]
                nearer = (least < best[to]) | ((least == best[to]) & (order < self.by_id[place[to]]))
                place[to[nearer]], best[to[nearer]] = self.id_order[order[nearer]], least[nearer]
        return place, best

    def cells(self, at: np.ndarray, weights: np.ndarray | None = None) -> Polygons:
        """The cells of the sites at the places ``at``; ``weights`` take the place of these sites' own."""
        x, y, w = self.x[at], self.y[at], self.w[at] if weights is None else weights
        out = Polygons.copies(self.domain, len(at))
        for r in range(self.rings + 1):
            reach = out.reach(x, y)
            d = (r - 1) * self.h  # sites of this ring are no nearer than that
            going = out.n > 0
            if d > 0:
                going &= (d * d + w - self.w_max) / (2 * d) <= reach
            going = np.flatnonzero(going)
            if not len(going):
                break
            room = max(1, PAIRS // (8 * r + 1))
            for some in (going[k : k + room] for k in range(0, len(going), room)):
                self._ring_cut(out, some, r, at, x, y, w, reach)
        return out

    def _ring_cut(self, out: Polygons, some: np.ndarray, r: int, at: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, reach: np.ndarray) -> None:
        row, j = self.ring(self.cx[at[some]], self.cy[at[some]], r)
        row = some[row]
        other = j != at[row]
        row, j = row[other], j[other]
        d = np.hypot(self.x[j] - x[row], self.y[j] - y[row])
        same = d == 0  # coincident sites: the heavier has the cell, of equal ones the first
        beaten = same & ((self.w[j] > w[row]) | ((self.w[j] == w[row]) & (self.ids[j] < self.ids[at[row]])))
        out.n[row[beaten]] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            cuts = ~same & (out.n[row] > 0) & ((d * d + w[row] - self.w[j]) / (2 * d) <= reach[row] * (1 + 1e-9))
        row, j, d = row[cuts], j[cuts], d[cuts]
        order = np.lexsort((j, d, row))
        row, j = row[order], j[order]
        px, py, qx, qy = x[row], y[row], self.x[j], self.y[j]
        a, b = 2 * (qx - px), 2 * (qy - py)
        c = qx * qx + qy * qy - px * px - py * py + w[row] - self.w[j]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        by_rank = np.argsort(rank, kind="stable")
        ends = np.searchsorted(rank[by_rank], np.arange(int(rank.max()) + 2)) if len(row) else [0]
        for lo, hi in zip(ends, ends[1:], strict=False):
            k = by_rank[lo:hi]
            k = k[out.n[row[k]] > 0]
            if len(k):
                out.cut(row[k], a[k], b[k], c[k], self.ids[j[k]])

    def cell(self, i: int, weight: float | None = None) -> tuple[list[tuple[float, float]], list[int]]:
        """Vertices, and for the edge after each vertex the neighbour's id (the domain's edges: -1, -2, ...).

        ``weight`` takes the place of the site's own.
        """
        return self.cells(np.array([i]), None if weight is None else np.array([float(weight)])).row(0)

    def areas(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.cells(at, weights).moments(self.x[at], self.y[at])[:, 0]

    def _edge_slopes(self, cells: Polygons, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each edge of ``cells``, those of the sites at ``at``: the row, the place of the site across, and what the area gains by the difference of their weights."""
        row, tag, ends = cells.edges()
        row, tag, ends = row[tag >= 0], tag[tag >= 0], ends[tag >= 0]
        by_id = np.argsort(self.ids)
        i, j = at[row], by_id[np.searchsorted(self.ids[by_id], tag)]
        return row, j, np.hypot(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1]) / (2 * np.hypot(self.x[i] - self.x[j], self.y[i] - self.y[j]))

    def slopes(self, cells: Polygons, at: np.ndarray) -> np.ndarray:
        """The derivatives of the areas of ``cells``, those of the sites at ``at`` (rows), by the weights of these sites (columns)."""
        row, j, each = self._edge_slopes(cells, at)
        place = np.full(len(self.ids), -1)
        place[at] = np.arange(len(at))
        out, inner = np.diag(np.bincount(row, weights=each, minlength=len(at))), place[j] >= 0
        np.add.at(out, (row[inner], place[j[inner]]), -each[inner])
        return out

    def raised(self, at: np.ndarray, goals: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
        """The cells' areas, and greater weights that leave no cell larger than its goal, or than it was, while all weights but
        those of ``at`` stay.

        The root of a cell's area is concave in all weights, and falls as others rise. So Newton's step for the roots of all
        visible cells of ``at`` together only raises weights and never leads too far.
        A hidden cell's weight is bracketed by steps that double, and the bracket is bisected until its lower end gives it a cell.
        """
        x, y, w = self.x[at], self.y[at], self.w[at].astype(float)
        cells = self.cells(at)
        now = cells.moments(x, y)[:, 0]
        slopes = self.slopes(cells, at)
        own = slopes.diagonal()
        short = (now < goals) & (now > 0) & (own > 0)
        if short.any():
            lack, seen = np.where(short, 2 * (np.sqrt(now * goals) - now), 0.0), np.flatnonzero((now > 0) & (own > 0))
            try:
                more = np.linalg.solve(slopes[np.ix_(seen, seen)], lack[seen])
            except np.linalg.LinAlgError:
                more = np.array([np.nan])
            # a singular or badly rounded system: each weight by itself
            sound = np.isfinite(more).all() and more.min() >= -1e-6 * more.max()
            w[seen] += np.maximum(more, 0) if sound else lack[seen] / own[seen]
        low, high, length = w.copy(), w + step, np.full(len(at), float(step))
        hidden = left = np.flatnonzero((now < goals) & ~short)
        while len(left):
            left = left[self.areas(at[left], high[left]) <= 0]
            low[left] = high[left]
            high[left] += 2 * length[left]
            length[left] *= 2
        left = hidden
        while len(left):
            area = self.areas(at[left], high[left])
            left, area = left[area > goals[left]], area[area > goals[left]]
            middle = (low[left] + high[left]) / 2
            between = (low[left] < middle) & (middle < high[left])
            left, middle = left[between], middle[between]
            some = self.areas(at[left], middle) > 0
            low[left[~some]], high[left[some]] = middle[~some], middle[some]
        w[hidden] = high[hidden]
        over = hidden[self.areas(at[hidden], high[hidden]) > goals[hidden]] if len(hidden) else hidden
        w[over] = low[over]
        return now, w


def _cut(poly: list, tags: list, a: float, b: float, c: float, tag: int) -> tuple[list, list]:
    """``poly`` where a * x + b * y <= c; the new edge gets ``tag``."""
    eps = 1e-12 * (abs(c) + math.hypot(a, b))
    gaps = [c - a * x - b * y for x, y in poly]
    if min(gaps) >= -eps:
        return poly, tags
    out, out_tags = [], []
    for k, (p, g) in enumerate(zip(poly, gaps, strict=True)):
        q, h = poly[(k + 1) % len(poly)], gaps[(k + 1) % len(poly)]
        inside, next_inside = g > eps, h > eps
        cross = (lambda t: (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))(g / (g - h)) if inside != next_inside else None
        if inside:
            out.append(p)
            out_tags.append(tags[k])
            if not next_inside:
                out.append(cross)
                out_tags.append(tag)
        elif next_inside:
            out.append(cross)
            out_tags.append(tags[k])
    return (out, out_tags) if len(out) > 2 else ([], [])


def power_cells(sites: DataFrame, domain: list[tuple[float, float]] = DOMAIN, weighted: bool = True, tile_sites: int = TILE_SITES) -> DataFrame:
    """(site_id, vs, neighbours) for every site (site_id, x, y, w); a hidden site has no vertices.

    ``neighbours`` names the site across the edge that follows each vertex.
    """
    spark = sites.sparkSession
    rows = stored(sites.select("site_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("w").cast("double") if weighted else F.lit(0e0)).alias("w")), "sites")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], CELL)
    placed = stored(_tiled(rows, n, max(tile_sites, -(-n // MAX_TILES))), "tiled-sites")
    tiles = Tiles(placed.groupBy("strip", "tile").agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))), F.max("w").alias("top")).orderBy("strip", "tile").toPandas())
    shared = spark.sparkContext.broadcast(tiles)
    beside = spark.createDataFrame(tiles.beside(), "strip int, tile int, home int, own boolean")

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        own = group["own"].to_numpy()
        s = Sites(*(group[c].to_numpy() for c in ("site_id", "x", "y", "w")), domain)
        return shared.value.opened(s, np.flatnonzero(own), int(group["home"].iloc[0]))

    first = placed.join(F.broadcast(beside), ["strip", "tile"]).drop("strip", "tile").groupBy("home").applyInPandas(cut, _OPEN)
    first = stored(first, "cells")
    shared.destroy()
    if first.where("size(ask) > 0").isEmpty():
        return first.select("site_id", "vs", "neighbours")
    asked = first.where("size(ask) > 0").select("site_id", "x", "y", "w", "vs", F.explode("ask").alias("home"))
    # what many cells ask of one tile is answered by several tasks
    shares = asked.groupBy("home").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shares"))
    asked = asked.join(shares, "home").select("*", F.pmod(F.hash("site_id"), F.col("shares")).alias("share")).drop("shares")
    number = spark.createDataFrame(tiles.numbers(), "strip int, tile int, home int")
    held = placed.join(F.broadcast(number), ["strip", "tile"]).join(shares, "home").select("site_id", "x", "y", "w", "home", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    cutters = asked.groupBy("home", "share").cogroup(held.groupBy("home", "share")).applyInPandas(_answers, "site_id long, by struct<site_id:bigint,x:double,y:double,w:double>")
    found = first.join(cutters.groupBy("site_id").agg(F.collect_list("by").alias("by")), "site_id", "left")

    def recut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_recut(*r) for r in batch[["site_id", "x", "y", "w", "vs", "neighbours", "by"]].itertuples(index=False)]
            yield pd.DataFrame({"site_id": batch["site_id"], "vs": [[{"x": a, "y": b} for a, b in v] for v, _ in done], "neighbours": [t for _, t in done]})

    return found.select("site_id", "x", "y", "w", "vs", "neighbours", "by").mapInPandas(recut, CELL)


_OPEN = "site_id long, x double, y double, w double, vs array<struct<x:double,y:double>>, neighbours array<long>, ask array<int>"


def _tiled(rows: DataFrame, n: int, size: int) -> DataFrame:
    """``rows`` with the strip of x and the tile of y in it, of about ``size`` sites each."""
    count = -(-n // size)
    strips = max(1, math.ceil(math.sqrt(count)))
    if count == 1:
        return rows.select("*", F.lit(0).alias("strip"), F.lit(0).alias("tile"))
    cuts = sorted(set(rows.approxQuantile("x", [i / strips for i in range(1, strips)], 1 / (8 * strips)))) if strips > 1 else []
    above = lambda at, c: F.size(F.filter(at, lambda v: v <= F.col(c)))
    placed = rows.withColumn("strip", above(F.array(*map(F.lit, cuts)), "x") if cuts else F.lit(0))
    shares = 4 * strips  # of a strip's sites; strips of many equal x hold more sites than others and take more of these
    tops = placed.groupBy("strip").agg(F.count("*").alias("n"), F.percentile_approx("y", [i / shares for i in range(1, shares)], 40 * shares).alias("ys"))
    wanted = F.least(F.lit(shares), F.ceil(F.col("n") / size))
    picks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), wanted - 1)), lambda i: F.get("ys", F.floor(i * shares / wanted).cast("int") - 1))
    tops = tops.select("strip", F.when(wanted > 1, picks).otherwise(F.expr("cast(array() as array<double>)")).alias("ys"))
    return placed.join(F.broadcast(tops), "strip").withColumn("tile", above(F.col("ys"), "y")).drop("ys")


class Tiles:
    """The boxes (x0, x1, y0, y1) and heaviest weights of all tiles, in the order of strip and tile."""

    def __init__(self, found: pd.DataFrame):
        self.strip, self.tile = found["strip"].to_numpy(), found["tile"].to_numpy()
        self.x0, self.x1, self.y0, self.y1, self.top = (found[c].to_numpy() for c in ("x0", "x1", "y0", "y1", "top"))

    def numbers(self) -> list[tuple[int, int, int]]:
        return [(int(s), int(t), i) for i, (s, t) in enumerate(zip(self.strip, self.tile, strict=True))]

    def around(self, home: int) -> list[int]:
        """``home`` and the tiles nearest to it, from its strip and the strips beside it."""
        s = self.strip[home]
        lo, hi = np.searchsorted(self.strip, [s - 1, s + 2])
        gap = np.hypot(*(np.maximum(0, np.maximum(a[lo:hi] - b[home], a[home] - b[lo:hi])) for a, b in ((self.x0, self.x1), (self.y0, self.y1))))
        middle = np.abs(self.y0[lo:hi] + self.y1[lo:hi] - self.y0[home] - self.y1[home])
        order = np.lexsort((middle, gap)) + lo
        return [home, *[int(i) for i in order if i != home][:BESIDE]]

    def beside(self) -> list[tuple[int, int, int, bool]]:
        """(strip, tile, home, own): which tiles go to the task of each."""
        return [(int(self.strip[i]), int(self.tile[i]), home, i == home) for home in range(len(self.strip)) for i in self.around(home)]

    def opened(self, s: Sites, own: np.ndarray, home: int) -> pd.DataFrame:
        """The cells of the sites at ``own`` among those at hand, and the tiles that could still cut each."""
        cells = _rows(s, own)
        away = np.ones(len(self.strip), dtype=bool)
        away[self.around(home)] = False
        away = np.flatnonzero(away)
        if len(away) and any(v for v, _ in cells):
            # first of all tiles those that could come near any of the cells' corners
            corners = [np.array(v) for v, _ in cells if v]
            box = np.concatenate(corners)
            (lx, ly), (hx, hy) = box.min(axis=0), box.max(axis=0)
            most = max(float((((c - (s.x[i], s.y[i])) ** 2).sum(axis=1)).max() - s.w[i]) for i, c in zip([i for i, (v, _) in zip(own, cells, strict=True) if v], corners, strict=True))
            gx = np.maximum(0, np.maximum(self.x0[away] - hx, lx - self.x1[away]))
            gy = np.maximum(0, np.maximum(self.y0[away] - hy, ly - self.y1[away]))
            away = away[gx * gx + gy * gy - self.top[away] <= most + 1e-9 * (1 + abs(most))]
        ask = [self._cutting(np.array(v), float(s.x[i]), float(s.y[i]), float(s.w[i]), away) if v else [] for i, (v, _) in zip(own.tolist(), cells, strict=True)]
        return pd.DataFrame({"site_id": s.ids[own], "x": s.x[own], "y": s.y[own], "w": s.w[own], "vs": [[{"x": a, "y": b} for a, b in v] for v, _ in cells], "neighbours": [t for _, t in cells], "ask": ask})

    def _cutting(self, v: np.ndarray, px: float, py: float, w: float, away: np.ndarray) -> list[int]:
        """Of the tiles ``away``, those that may have a site with a smaller power distance from a corner."""
        power = (v[:, 0] - px) ** 2 + (v[:, 1] - py) ** 2 - w
        gx = np.maximum(0, np.maximum(self.x0[away] - v[:, :1], v[:, :1] - self.x1[away]))
        gy = np.maximum(0, np.maximum(self.y0[away] - v[:, 1:], v[:, 1:] - self.y1[away]))
        near = gx * gx + gy * gy - self.top[away] <= (power + 1e-9 * (1 + np.abs(power)))[:, None]
        return away[near.any(axis=0)].tolist()


def _cut_by(poly: list, tags: list, px: float, py: float, w: float, own: int, others: list[tuple[int, float, float, float]]) -> tuple[list, list]:
    """A cell (site ``own`` at px, py) cut by the bisectors towards ``others`` (id, x, y, w), nearest first."""
    for q, qx, qy, qw in sorted(others, key=lambda o: (math.hypot(o[1] - px, o[2] - py), o[0])):
        if (qx, qy) == (px, py):
            if (qw, -q) > (w, -own):
                return [], []
            continue
        poly, tags = _cut(poly, tags, 2 * (qx - px), 2 * (qy - py), qx * qx + qy * qy - px * px - py * py + w - qw, q)
        if not poly:
            break
    return poly, tags


def _answers(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """(site_id, by): for each cell that asks a tile, the tile's sites that have an edge with it or hide it."""
    ids, x, y, w = (held[c].to_numpy() for c in ("site_id", "x", "y", "w"))
    out = []
    for own, px, py, pw, vs in asked[["site_id", "x", "y", "w", "vs"]].itertuples(index=False):
        v = np.array([(c["x"], c["y"]) for c in vs])
        power = (v[:, 0] - px) ** 2 + (v[:, 1] - py) ** 2 - pw
        nearer = ((x - v[:, :1]) ** 2 + (y - v[:, 1:]) ** 2 - w <= power[:, None] + 1e-9 * (1 + np.abs(power))[:, None]).any(axis=0)
        some = [(int(ids[k]), float(x[k]), float(y[k]), float(w[k])) for k in np.flatnonzero(nearer) if ids[k] != own]
        poly, tags = _cut_by([tuple(c) for c in v.tolist()], [-1] * len(v), px, py, pw, own, some)
        left = set(tags)
        out += [(own, dict(zip(("site_id", "x", "y", "w"), q, strict=True))) for q in some if not poly or q[0] in left]
    return pd.DataFrame(out, columns=["site_id", "by"])


def _recut(site_id: int, x: float, y: float, w: float, vs: list, neighbours: list, by: list | None) -> tuple[list, list]:
    poly, tags = [(c["x"], c["y"]) for c in vs], [int(t) for t in neighbours]
    return (poly, tags) if by is None else _cut_by(poly, tags, x, y, w, site_id, [(q["site_id"], q["x"], q["y"], q["w"]) for q in by])


def _rows(s: Sites, at: np.ndarray) -> list[tuple[list, list]]:
    """Sites.cell of each place."""
    return [cells.row(i) for k in range(0, len(at), CELLS) for cells in (s.cells(at[k : k + CELLS]),) for i in range(len(cells))]


def _spread(spark: SparkSession, n: int) -> DataFrame:
    """The places 0 ... n - 1 of held sites, over as many tasks as their cells are worth."""
    return spark.range(0, n, 1, max(1, min(n // 64 + 1, 4 * spark.sparkContext.defaultParallelism)))


@contextmanager
def cells_of(spark: SparkSession, sites: Sites) -> Iterator[DataFrame]:
    """The cells of :func:`power_cells` for sites that are sent to tasks whole, within the block."""
    shared = spark.sparkContext.broadcast(sites)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for batch in batches:
            found = _rows(s, batch["id"].to_numpy())
            yield pd.DataFrame({"site_id": s.ids[batch["id"]], "vs": [[{"x": a, "y": b} for a, b in v] for v, _ in found], "neighbours": [t for _, t in found]})

    try:
        yield _spread(spark, len(sites.ids)).mapInPandas(compute, CELL)
    finally:
        shared.destroy()


@contextmanager
def cells_at_hand(sites: DataFrame, domain: list[tuple[float, float]] = DOMAIN, weighted: bool = True) -> Iterator[DataFrame]:
    """:func:`power_cells`, to be evaluated within the block: up to HELD_SITES sites go to tasks whole, more are tiled."""
    rows = sites.select("site_id", "x", "y", (F.col("w") if weighted else F.lit(0e0)).alias("w"))
    held = rows.limit(HELD_SITES + 1).toPandas().sort_values("site_id")
    if len(held) > HELD_SITES:
        yield power_cells(rows, domain)
    else:
        with cells_of(sites.sparkSession, Sites(*(held[c].to_numpy() for c in ("site_id", "x", "y", "w")), domain)) as cells:
            yield cells


def _gathered(spark: SparkSession, sites: Sites, compute, columns: str, shared) -> pd.DataFrame:
    """The rows that tasks ``compute`` for the places of the sites, CELLS at a time, in order of place; what they share goes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["id"].to_numpy()
            for k in range(0, len(at), CELLS):
                yield compute(shared.value, at[k : k + CELLS])

    try:
        return _spread(spark, len(sites.ids)).mapInPandas(each, columns).toPandas().sort_values("place", ignore_index=True)
    finally:
        shared.destroy()


def measured(spark: SparkSession, sites: Sites, raster: Grid | None = None) -> pd.DataFrame:
    """(place, mass, mx, my, sq): each held site's cell's area and integrals of dx, dy and dx^2 + dy^2 about the site; of
    the raster's mass in it where one is given.

    A solver's evaluation: one stage without a shuffle, and a few numbers a site come back.
    """

    def compute(shared: tuple[Sites, Grid | None], at: np.ndarray) -> pd.DataFrame:
        s, grid = shared
        cells = s.cells(at)
        x, y = s.x[at], s.y[at]
        got = cells.moments(x, y) if grid is None else grid.moments(cells, x, y)
        return pd.DataFrame(np.column_stack([at, got]), columns=["place", "mass", "mx", "my", "sq"]).astype({"place": "int64"})

    return _gathered(spark, sites, compute, "place long, mass double, mx double, my double, sq double", spark.sparkContext.broadcast((sites, raster)))


def edged(spark: SparkSession, sites: Sites, raster: Grid | None = None) -> pd.DataFrame:
    """(place, neighbour, len): the edges between held sites' cells, each from both of its sides; of the raster along them where one is given."""

    def compute(shared: tuple[Sites, Grid | None], at: np.ndarray) -> pd.DataFrame:
        s, grid = shared
        row, tag, ends = s.cells(at).edges()
        row, tag, ends = row[tag >= 0], tag[tag >= 0], ends[tag >= 0]
        length = np.hypot(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1]) if grid is None else grid.along(ends)
        found = pd.DataFrame({"place": at[row], "neighbour": tag, "len": length}).groupby(["place", "neighbour"], as_index=False)["len"].sum()
        return found[found["len"] > 1e-9]

    return _gathered(spark, sites, compute, "place long, neighbour long, len double", spark.sparkContext.broadcast((sites, raster)))


def raised(spark: SparkSession, sites: Sites, goals: np.ndarray, step: float) -> pd.DataFrame:
    """(place, area, w): each held site's cell's area, and its weight raised by Sites.raised, but not that of the first site; in one stage without a shuffle.

    The sites of a task's block are raised together, by joint Newton steps, again and again, until their cells lack next to nothing (a tenth of
    what they lacked, where there are other blocks) or SWEEPS times, while the others' weights stay. Weights only rise, and as the Hessian's other entries are
    negative a block stays below what all sites' solution gives it.
    """

    def compute(shared: tuple[Sites, np.ndarray], at: np.ndarray) -> pd.DataFrame:
        s, goals = copy(shared[0]), shared[1]
        s.w = s.w.copy()
        free, area, enough = at[at > 0], s.areas(at), 0.0
        for _ in range(SWEEPS if len(free) else 0):
            now, s.w[free] = s.raised(free, goals[free], step)
            s.w_max = float(s.w.max())
            lack = (goals[free] - now).max()
            enough = max(LACK * goals.sum(), enough or (0.1 * lack if len(at) < len(s.w) else 0.0))
            if lack <= enough:
                break
        return pd.DataFrame({"place": at, "area": area, "w": s.w[at]})

    return _gathered(spark, sites, compute, "place long, area double, w double", spark.sparkContext.broadcast((sites, goals)))


def cell_edges(cells: DataFrame) -> DataFrame:
    """(site_id, neighbour, len): the edges between cells, each from both of its sides."""
    follows = lambda i: F.element_at("vs", (i + 1) % F.size("vs") + 1)
    e = cells.where("size(vs) > 0").select("site_id", "vs", F.posexplode("neighbours").alias("i", "neighbour")).where("neighbour >= 0")
    p, q = F.element_at("vs", F.col("i") + 1), follows(F.col("i"))
    return e.select("site_id", "neighbour", F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("len")).groupBy("site_id", "neighbour").agg(F.sum("len").alias("len")).where("len > 1e-9")


def uniform_cell_moments(cells: DataFrame, sites: DataFrame, domain_area: float) -> DataFrame:
    """Per site, of the uniform density: mu, sqint (about the site), area, cx, cy and g = mu - m."""
    both = sites.join(cells.select("site_id", "vs"), "site_id")
    a, c = G.area(F.col("vs")), G.centroid(F.col("vs"))
    square = G.squared_distance_integral(F.col("vs"), F.col("x"), F.col("y"))
    return both.select("site_id", "x", "y", "m", "w", a.alias("area"), c["x"].alias("cx"), c["y"].alias("cy"), (a / domain_area).alias("mu"), (square / domain_area).alias("sqint"), (a / domain_area - F.col("m")).alias("g"))
