"""Solvers for the weights whose power cells hold the given masses.

The objective is convex in the weights and costs one Spark job an evaluation: the
cells are computed and measured in tasks, and one row per site comes back. The
iterations on these rows are small numpy steps on the driver.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from contextlib import AbstractContextManager
from dataclasses import dataclass, field
from functools import cached_property, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massflow.operators import hierarchy
from massflow.operators.cells import HELD_SITES, Sites, cells_at_hand, cells_of, raised
from massflow.operators.densities import RasterDensity, UniformDensity
from massflow.operators.hull import least_norm_shares
from massflow.operators.objective import hessian, running_bounds
from massflow.operators.precondition import Sparse, conjugate_gradients
from massflow.operators.search import Along, Trial, backtracked, searched
from massflow.sources.fixtures import DOMAIN
from massflow.sources.store import stored


@dataclass
class Objective:
    """The transport objective between a density and ``sites`` (site_id, x, y, m)."""

    sites: DataFrame
    density: UniformDensity
    evaluations: int = 0

    def __post_init__(self) -> None:
        # sites at one place are one Dirac: no weights could give each a cell, so they have one together
        place = self.sites.groupBy("x", "y").agg(F.min("site_id").alias("site_id"), F.sum("m").alias("m"), F.count("*").alias("n"))
        self.held: pd.DataFrame = place.select("site_id", "x", "y", "m", "n").orderBy("site_id").toPandas()

    @property
    def n(self) -> int:
        """The number of distinct places."""
        return len(self.held)

    def table(self, w: np.ndarray) -> DataFrame:
        return self.sites.sparkSession.createDataFrame(self.held[["site_id", "x", "y", "m"]].assign(w=w), "site_id long, x double, y double, m double, w double")

    def stats(self, w: np.ndarray, s: pd.DataFrame | None = None) -> DataFrame:
        """(site_id, x, y, m, w, mu, sqint, g) of all sites; sites at one place share its cell by their masses. ``s``: what an evaluation at ``w`` measured."""
        s = self._measured(w) if s is None else s
        at = self.held[["x", "y"]].assign(total=self.held["m"], n=self.held["n"], w=w, all_mu=s["mu"].to_numpy(), all_sq=s["sqint"].to_numpy())
        places = self.sites.sparkSession.createDataFrame(at, "x double, y double, total double, n long, w double, all_mu double, all_sq double")
        part = F.when(F.col("n") == 1, 1e0).when(F.col("total") > 0, F.col("m") / F.col("total")).otherwise(1 / F.col("n"))
        both = self.sites.select("site_id", "x", "y", "m").join(places, ["x", "y"]).withColumns({"mu": F.col("all_mu") * part, "sqint": F.col("all_sq") * part})
        return both.select("site_id", "x", "y", "m", "w", "mu", "sqint", (F.col("mu") - F.col("m")).alias("g"))

    def placed(self, w: np.ndarray) -> Sites:
        return Sites(*(self.held[c].to_numpy() for c in ("site_id", "x", "y")), w, self.density.domain)

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray, pd.DataFrame]:
        """f, its gradient, and the measured cells."""
        self.evaluations += 1
        s = self._measured(w)
        g = s["mu"].to_numpy() - self.held["m"].to_numpy()
        return float(-(s["sqint"].sum() - (g * w).sum())), g, s

    def cells(self, w: np.ndarray, table: DataFrame) -> AbstractContextManager[DataFrame]:
        """The cells, to be evaluated within the block."""
        return cells_of(table.sparkSession, self.placed(w)) if self.n <= HELD_SITES else cells_at_hand(table, self.density.domain)

    def _measured(self, w: np.ndarray) -> pd.DataFrame:
        """(site_id, mu, sqint), in the order of the places."""
        s = self.density.measured(self.sites.sparkSession, self.placed(w)) if self.n <= HELD_SITES else None
        if s is not None:
            return s[["mu", "sqint"]].assign(site_id=self.held["site_id"])
        t = self.table(w)
        with self.cells(w, t) as cells:
            return self.density.over(cells, t).select("site_id", "mu", "sqint").toPandas().sort_values("site_id", ignore_index=True)

    @cached_property
    def total(self) -> float:
        return self.density.total(self.sites.sparkSession)

    def hessian(self, w: np.ndarray) -> Sparse:
        place = lambda c: np.searchsorted(self.held["site_id"].to_numpy(), c.to_numpy())
        e = self.density.edged(self.sites.sparkSession, self.placed(w)) if self.n <= HELD_SITES else None
        if e is not None:
            i, j, x, y = e["place"].to_numpy(), place(e["neighbour"]), self.held["x"].to_numpy(), self.held["y"].to_numpy()
            h = -e["len"].to_numpy() / self.total / (2 * np.hypot(x[i] - x[j], y[i] - y[j]))
            own = np.flatnonzero(np.bincount(i, minlength=self.n))
            return Sparse(np.r_[i, own], np.r_[j, own], np.r_[h, -np.bincount(i, weights=h, minlength=self.n)[own]], self.n)
        t = self.table(w)
        with self.cells(w, t) as cells:
            h = hessian(self.density.edges(cells), t, self.total).toPandas()
        return Sparse(place(h["i"]), place(h["j"]), h["h"].to_numpy(), self.n)


@dataclass
class Uniform(Objective):
    """The objective for the uniform density of a domain."""

    density: UniformDensity = field(default_factory=UniformDensity)

    def raised(self, w: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's mass, and weights raised block by block until the block's cells have their sites' masses if all others stayed."""
        if self.n > HELD_SITES:
            raise ValueError(f"coordinate steps send {HELD_SITES} sites to tasks at most")
        s = raised(self.sites.sparkSession, self.placed(w), self.held["m"].to_numpy() * self.density.area, step)
        return s["area"].to_numpy() / self.density.area, s["w"].to_numpy()


def Raster(sites: DataFrame, pixels: DataFrame, domain: list[tuple[float, float]] = DOMAIN) -> Objective:  # noqa: N802
    """The objective for a raster's density (x, y, v), each pixel covered and integrated exactly."""
    return Objective(sites, RasterDensity(domain, stored(pixels, "pixels")))  # read at each evaluation


@dataclass
class Log:
    """What each accepted step gave, a row each: also the bracket of the distance that the steps so far
    leave, the seconds since the start, and how far the weights are from a known solution (null without one)."""

    diameter: float = 0.0
    known: np.ndarray | None = None
    rows: list[tuple] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)

    def add(self, level: int, f: float, g: np.ndarray, s: pd.DataFrame, w: np.ndarray | None = None) -> None:
        w2, away = float(np.sqrt(max(0.0, s["sqint"].sum()))), None
        if self.known is not None and w is not None:
            away = float(np.linalg.norm(w - self.known - (w - self.known).mean())) / len(w)
        werr = float(np.sqrt(np.abs(g).sum() / 2)) * self.diameter
        self.rows.append((level, len(self.rows), f, float(np.abs(g).max()), float(np.abs(g).sum()), int((s["mu"] != 0).sum()), w2, werr, away, time.monotonic() - self.began))

    def frame(self, spark) -> DataFrame:
        steps = spark.createDataFrame(self.rows, "level int, iteration int, f double, ginf double, g1 double, active int, w double, werr double, distance double, seconds double")
        return running_bounds(steps.withColumn("run", F.lit(0))).drop("run")


#: Tells from the gradient and the measured cells whether to stop.
Stop = Callable[[np.ndarray, pd.DataFrame], bool]


def norm_inf(eps: float) -> Stop:
    return lambda g, s: float(np.abs(g).max()) <= eps


def norm_p(eps: float, p: float) -> Stop:
    return lambda g, s: float((np.abs(g) ** p).sum() ** (1 / p)) <= eps


@dataclass
class WassersteinStop:
    """Stops when the bracket of the distance that all steps so far leave is narrow enough.

    A step brackets the distance by its own value and error: the root of the
    misaffected mass times the diameter, and the error of the level's quantisation.
    Where the latter alone exceeds the goal, the level is left once its gradient
    is small. The bracket outlives a level.
    """

    threshold: float
    diameter: float
    relative: bool = True
    quantisation: float = 0.0
    low: float = 0.0
    high: float = 1e6

    def __call__(self, g: np.ndarray, s: pd.DataFrame) -> bool:
        w = float(np.sqrt(max(0.0, s["sqint"].sum())))
        error = float(np.sqrt(np.abs(g).sum() / 2)) * self.diameter + self.quantisation
        self.low, self.high = max(self.low, w - error), min(self.high, w + error)
        middle = (self.low + self.high) / 2
        goal = self.threshold * middle if self.relative else self.threshold
        return abs(self.high - middle) < goal or (self.quantisation >= goal and float(np.abs(g).max()) <= 1e-5)


def stop_named(name: str, eps: float, diameter: float) -> Stop:
    """The stopping rule of a command line's name for it."""
    if name == "norm-inf-gradient":
        return norm_inf(eps)
    if name in ("wasserstein-error", "wasserstein-abs-error"):
        return WassersteinStop(eps, diameter, relative=name == "wasserstein-error")
    raise ValueError(f"no such stopping rule: {name}")


#: Takes what is found along a direction, the start and a first length; gives a trial or None.
Search = Callable[[Along, Trial, float], Trial | None]
wolfe: Search = partial(backtracked, conditions="wolfe")


def _stepped(f, w: np.ndarray, f0: float, g0: np.ndarray, step: np.ndarray, t: float, search: Search):
    """Weights, value, gradient and cells where the search ends; None if nothing lowers f."""

    def along(t: float) -> Trial:
        f1, g1, s1 = f(w + t * step)
        return Trial(t, f1, float(g1 @ step), (w + t * step, f1, g1, s1))

    got = search(along, Trial(0.0, f0, float(g0 @ step)), t)
    return got.found if got else None


def lbfgs(f: Objective, w: np.ndarray, stop: Stop, memory: int = 10, max_steps: int = 1000, log: Log | None = None, level: int = 0, search: Search = searched, pinned: bool = False) -> np.ndarray:
    """Limited-memory quasi-Newton descent, begun from the Hessian at every ``memory``-th step where all cells have mass, so that
    the number of steps hardly grows with the number of sites.

    f doesn't change with a shift of all weights: the result has mean 0 or, if ``pinned``, the
    last weight is held at 0 on the way, so that f isn't flat in any direction.
    """
    free = np.ones(len(w))
    if pinned:
        w, free[-1] = w - w[-1], 0.0

    def at(v: np.ndarray):
        f1, g1, s1 = f(v)
        return f1, g1 * free, s1

    # gradients sum to 0, so the last entry follows from the others
    whole = lambda g: np.append(g[:-1], -g[:-1].sum()) if pinned else g
    f0, g, s = at(w)
    pairs: deque = deque(maxlen=memory)
    metric: Sparse | None = None
    for k in range(max_steps):
        if log:
            log.add(level, f0, whole(g), s, w)
        if stop(whole(g), s):
            break
        if k % max(1, memory) == 0 and len(w) > 1 and (s["mu"] > 0).all():
            metric = f.hessian(w).without_last()
        q, alphas = g.copy(), []
        for dw, dg in reversed(pairs):
            a = (dw @ q) / (dw @ dg)
            alphas.append(a)
            q -= a * dg
        # between the two loops: the last Hessian's inverse, else a multiple of the identity
        p = np.append(conjugate_gradients(metric, q[:-1])[0], 0.0) if metric is not None else q
        scaled = metric is not None and bool(np.isfinite(p).all()) and p @ q > 0
        if scaled:
            q = p
        elif pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (dw, dg), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - (dg @ q) / (dw @ dg)) * dw
        found = _stepped(at, w, f0, g, -q, 1.0 if pairs or scaled else min(1.0, 1 / np.abs(g).sum()), search)
        if found is None:
            break
        w1, f1, g1, s = found
        if (w1 - w) @ (g1 - g) > 1e-18:
            pairs.append((w1 - w, g1 - g))
        w, f0, g = w1, f1, g1
    return w if pinned else w - w.mean()


def gradient_descent(f: Objective, w: np.ndarray, stop: Stop, step: float | None = None, max_steps: int = 1000, log: Log | None = None, search: Search = wolfe) -> np.ndarray:
    """Steepest descent, by line search or with a constant ``step``.

    The search begins at the length that the last step's change of the gradient suggests.
    """
    f0, g, s = f(w)
    t = min(1.0, 1 / max(1e-30, float(np.abs(g).sum())))
    for _ in range(max_steps):
        if log:
            log.add(0, f0, g, s, w)
        if stop(g, s):
            break
        if step is not None:
            w = w - step * g
            f0, g, s = f(w)
            continue
        found = _stepped(f, w, f0, g, -g, t, search)
        if found is None:
            break
        moved, turned = found[0] - w, found[2] - g
        t = float(moved @ moved) / max(1e-30, float(moved @ turned))
        w, f0, g, s = found
    return w - w.mean()


def subgradient(f: Objective, w: np.ndarray, stop: Stop, memory: int = 10, max_steps: int = 1000, log: Log | None = None, search: Search = searched) -> np.ndarray:
    """Descent against the point of least norm in the hull of the last ``memory`` gradients.

    That point lowers f along every one of them, so steps don't go to and fro across a valley.
    Where it is far shorter than the gradient the kept ones say nothing of the way any more: all but the last are dropped.
    """
    f0, g, s = f(w)
    kept, t = deque([g], maxlen=memory), min(1.0, 1 / max(1e-30, float(np.abs(g).sum())))
    for _ in range(max_steps):
        if log:
            log.add(0, f0, g, s, w)
        if stop(g, s):
            break
        held = np.stack(kept)
        p = least_norm_shares(held @ held.T) @ held
        if p @ p < 0.1 * (g @ g):
            kept, p = deque([g], maxlen=memory), g
        found = _stepped(f, w, f0, g, -p, t, search)
        if found is None and len(kept) > 1:
            kept = deque([g], maxlen=memory)
            found = _stepped(f, w, f0, g, -g, t, search)
        if found is None:
            break
        moved, turned = found[0] - w, found[2] - g
        t = float(moved @ moved) / max(1e-30, float(moved @ turned))
        w, f0, g, s = found
        kept.append(g)
    return w - w.mean()


def unhidden(f: Objective, w: np.ndarray, tries: int = 3, least: float = 0.1) -> np.ndarray:
    """``w`` scaled back by halves until every cell has ``least`` of its site's mass, as steps from almost hidden cells are short;
    where that fails, zero weights, whose cells are those of the nearest site."""
    w = w - w.mean()
    for _ in range(tries):
        if (f(w)[2]["mu"].to_numpy() > least * f.held["m"].to_numpy()).all():
            return w
        w = w / 2
    return np.zeros_like(w)


def newton(f: Objective, w: np.ndarray, stop: Stop, max_steps: int = 60, log: Log | None = None) -> np.ndarray:
    """Damped Newton steps with the last weight fixed, by conjugate gradients with an incomplete Cholesky factor; a step
    that empties a cell is halved.

    Where cells are empty to begin with the Hessian says nothing of them, so the weights are
    scaled back first; descent goes first where a site has no cell even without weights.
    """
    f0, g, s = f(w)
    if (s["mu"] <= 0).any():
        w = unhidden(f, w / 2)
        f0, g, s = f(w)
    if (s["mu"] <= 0).any():
        w = lbfgs(f, w, lambda g, s: float(s["mu"].min()) > 0, max_steps=max_steps, log=log)
        f0, g, s = f(w)
    for _ in range(max_steps):
        if log:
            log.add(0, f0, g, s, w)
        if stop(g, s):
            break
        step = np.append(conjugate_gradients(f.hessian(w).without_last(), -g[:-1])[0], 0.0)
        floor, t = 0.5 * min(float(s["mu"].min()), float(f.held["m"].min())), 1.0
        for _ in range(20):
            f1, g1, s1 = f(w + t * step)
            if s1["mu"].min() >= floor and np.linalg.norm(g1) <= (1 - t / 2) * np.linalg.norm(g) + 1e-15:
                break
            t *= 0.5
        else:
            break
        w, f0, g, s = w + t * step, f1, g1, s1
    return w - w.mean()


def coordinate(f: Uniform, w: np.ndarray, stop: Stop, max_steps: int = 2000, log: Log | None = None) -> np.ndarray:
    """Weights are raised one by one, each by a bracket that is closed by chords and halves, until its cell has its site's mass.

    All but the first site begin below what gives them a cell. A step raises each
    weight whose cell is too small as if the others stayed, all in one job; as
    raised weights only take from other cells, no cell but the first one's ever
    exceeds its mass, and the weights rise towards the solution. The masses that
    ``stop`` sees are those before a step.
    """
    across = max(a for a, _ in f.density.domain) - min(a for a, _ in f.density.domain), max(b for _, b in f.density.domain) - min(b for _, b in f.density.domain)
    w = np.zeros(f.n)
    w[1:] = -2 * float(np.hypot(*across)) ** 2
    for _ in range(max_steps):
        mu, better = f.raised(w, float(across[0] * across[1]) / f.n)
        g = mu - f.held["m"].to_numpy()
        s = pd.DataFrame({"site_id": f.held["site_id"], "mu": mu})
        if log:
            f0, g, s = f(w)
            log.add(0, f0, g, s, w)
        if stop(g, s):
            break
        better[0] = w[0]
        w = better
    return w - w.mean()


def multiscale(hier: DataFrame, stop: Stop, max_steps: int = 1000, log: Log | None = None, density: UniformDensity | None = None, solve: Callable | None = None) -> DataFrame:
    """(level, site_id, w, w2, error, evaluations, converged) from the coarsest level to the finest, each begun at its parents' weights,
    scaled back where they hide a cell.

    ``error`` bounds w2 from the finest level: the root of the misaffected mass times
    the diameter, and the distance between the levels. ``density`` is the uniform one of the fixtures' domain unless named; ``solve`` takes the
    place of :func:`lbfgs`.
    """
    hier = stored(hier, "hierarchy")
    weights, out = None, None
    top = hier.agg(F.max("level")).first()[0] or 0
    for level in range(top, -1, -1):
        at = hier.where(F.col("level") == level)
        f = Objective(at, density) if isinstance(density, RasterDensity) else Uniform(at, density or UniformDensity())
        w = np.zeros(f.n)
        if weights is not None:
            start = hierarchy.prolonged(hier, weights, level, level + 1).join(F.broadcast(f.table(w).select("site_id")), "site_id")
            w = unhidden(f, start.orderBy("site_id").toPandas()["w"].to_numpy())
        moved = hierarchy.transport_distance(hier, 0, level).first()["w2"] or 0.0 if level else 0.0
        if isinstance(stop, WassersteinStop):
            stop.quantisation = moved
        w = solve(f, w, stop, log=log) if solve else lbfgs(f, w, stop, max_steps=max_steps, log=log, level=level)
        _, g, s = f(w)
        across = float(np.hypot(np.ptp(f.held["x"]), np.ptp(f.held["y"])))
        w2, error = float(np.sqrt(max(0.0, s["sqint"].sum()))), float(np.sqrt(np.abs(g).sum() / 2) * across + moved)
        weights = f.stats(w, s).select("site_id", "w")
        what = {"w2": F.lit(w2), "error": F.lit(error), "evaluations": F.lit(f.evaluations), "converged": F.lit(bool(stop(g, s)))}
        rows = weights.select(F.lit(level).alias("level"), "site_id", "w").withColumns(what)
        out = rows if out is None else out.unionByName(rows)
    return stored(out, "weights")
