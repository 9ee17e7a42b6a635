"""What must stay as it is when tables grow: coincident sites, few jobs, cells and rasters as arrays."""

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from massflow.functions.clip import Grid
from massflow.operators import cells, cluster, density, greedy, solvers
from massflow.operators.cells import Sites, _cut_by
from massflow.operators.densities import RasterDensity
from massflow.sources.fixtures import DOMAIN

BOX = [(0.0, 0.0), (12.0, 0.0), (12.0, 6.0), (0.0, 6.0)]
SCHEMA = "site_id long, x double, y double, m double, w double"


def sites_of(spark, n, seed, twice=0):
    """``n`` sites, the first ``twice`` of them again at the same place with another mass."""
    draw = np.random.default_rng(seed)
    x, y, m = draw.random(n + twice) * 12, draw.random(n + twice) * 6, draw.random(n + twice) + 0.5
    x[n:], y[n:] = x[:twice], y[:twice]
    return spark.createDataFrame([(i, *map(float, r), 0.0) for i, r in enumerate(zip(x, y, m / m.sum(), strict=True))], SCHEMA)


def raster(spark):
    return spark.createDataFrame([(x, y, (5 * x + 3 * y) % 7 + 1) for x in range(12) for y in range(6)], "x int, y int, v int")


@pytest.mark.parametrize(("n", "weight"), [(1, 0.0), (2, 0.0), (40, 3.0), (300, 0.1), (300, 20.0)])
def test_cells_cut_together_are_those_cut_by_all_others(n, weight):
    draw = np.random.default_rng(n)
    x, y, w = draw.random(n) * 49, draw.random(n) * 10, draw.random(n) * weight
    x[-1], y[-1] = x[0], y[0]
    s = Sites(np.arange(n), x, y, w, DOMAIN)
    got = s.cells(np.arange(n))
    area = got.moments(x, y)[:, 0]
    assert area.sum() == pytest.approx(490)
    for i in range(n):
        others = [(j, float(x[j]), float(y[j]), float(w[j])) for j in range(n) if j != i]
        poly, tags = _cut_by(list(DOMAIN), [-1, -2, -3, -4], float(x[i]), float(y[i]), float(w[i]), i, others)
        p = np.array(poly).reshape(-1, 2)
        q = np.roll(p, -1, axis=0)
        assert area[i] == pytest.approx((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2, abs=1e-9) and set(got.row(i)[1]) == set(tags)


@pytest.mark.parametrize("corners", [False, True])
def test_rasters_as_arrays_give_what_the_join_gives(spark, corners):
    s = sites_of(spark, 15, 6)
    at = s.orderBy("site_id").toPandas()
    placed = Sites(at.site_id.to_numpy(), at.x.to_numpy(), at.y.to_numpy(), np.zeros(15), BOX)
    over = RasterDensity(BOX, raster(spark), corners=corners)
    got = over.measured(spark, placed)
    joined = density.cell_image_moments(cells.power_cells(s, BOX), s, raster(spark), corners).orderBy("site_id").toPandas()
    for c in ("mu", "sqint"):
        assert got[c].to_numpy() == pytest.approx(joined[c].to_numpy(), abs=1e-9)
    assert (at.x + got.mx / got.mu).to_numpy() == pytest.approx(joined.cx.to_numpy(), abs=1e-9)
    e = over.edged(spark, placed).rename(columns={"place": "site_id"}).set_index(["site_id", "neighbour"])["len"]
    want = over.edges(cells.power_cells(s, BOX)).toPandas().set_index(["site_id", "neighbour"])["len"]
    assert e.sort_index().to_dict() == pytest.approx(want.sort_index().to_dict(), abs=1e-9)
    assert Grid.of(*(np.array([]),) * 3).v.sum() == 0 and isinstance(joined, pd.DataFrame)



@pytest.mark.parametrize("solve", [solvers.newton, solvers.lbfgs, partial(solvers.lbfgs, pinned=True)])
@pytest.mark.parametrize("pixels", [False, True])
def test_sites_at_one_place_share_its_cell_by_their_masses(spark, solve, pixels):
    s = sites_of(spark, 12, 1, twice=4)
    f = solvers.Objective(s, RasterDensity(BOX, raster(spark))) if pixels else solvers.Uniform(s, solvers.UniformDensity(BOX))
    w = solve(f, np.zeros(f.n), solvers.norm_inf(1e-6))
    got = f.stats(w).toPandas()
    assert f.n == 12 and sorted(got.site_id) == list(range(16)) and got.g.abs().max() <= 1e-6
    assert got.mu.sum() == pytest.approx(1) and got.groupby(["x", "y"]).w.nunique().max() == 1


def test_newton_meets_masses_of_sites_that_all_share_places(spark):
    s = sites_of(spark, 9, 8, twice=9)
    f = solvers.Uniform(s, solvers.UniformDensity(BOX))
    got = f.stats(solvers.newton(f, np.zeros(f.n), solvers.norm_inf(1e-6))).toPandas()
    assert f.n == 9 and len(got) == 18 and got.g.abs().max() <= 1e-6 and f.evaluations <= 20


@pytest.mark.parametrize("pinned", [False, True])
def test_lbfgs_takes_few_evaluations_for_many_sites(spark, pinned):
    f = solvers.Uniform(sites_of(spark, 400, 3), solvers.UniformDensity(BOX))
    w = solvers.lbfgs(f, np.zeros(400), solvers.norm_inf(1e-6), pinned=pinned)
    assert np.abs(f(w)[1]).max() <= 1e-6 and f.evaluations <= 60


def test_coordinate_steps_of_a_block_are_one_job(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(solvers, "raised", lambda *a: jobs.append(1) or cells.raised(*a))
    f = solvers.Uniform(sites_of(spark, 12, 4), solvers.UniformDensity(BOX))
    w = solvers.coordinate(f, np.zeros(12), solvers.norm_inf(1e-6))
    assert np.abs(f(w)[1]).max() <= 1e-6 and len(jobs) <= 3


def test_multiscale_gives_every_coincident_site_a_row(spark):
    low = sites_of(spark, 12, 2, twice=4).select(F.lit(0).alias("level"), "site_id", "x", "y", "m", (F.col("site_id") % 3).alias("parent_id"))
    mean = lambda c: (F.sum(F.col("m") * F.col(c)) / F.sum("m")).alias(c)
    up = low.groupBy(F.col("parent_id").alias("site_id")).agg(mean("x"), mean("y"), F.sum("m").alias("m"))
    hier = low.unionByName(up.withColumns({"level": F.lit(1), "parent_id": F.lit(None).cast("long")}))
    for over in (None, RasterDensity(BOX, raster(spark))):
        got = solvers.multiscale(hier, solvers.norm_inf(1e-6), density=over, solve=solvers.newton).toPandas()
        assert got.converged.all() and sorted(got[got.level == 0].site_id) == list(range(16)) and len(got) == 19


def test_nearest_of_held_sites_is_the_nearest_of_all():
    draw = np.random.default_rng(9)
    x, y = draw.integers(0, 40, 300) / 2, draw.integers(0, 20, 300) / 2  # ties and coincident sites
    s = Sites(draw.permutation(300), x, y, np.zeros(300), [])
    px, py = draw.integers(-40, 120, 500) / 4, draw.integers(-40, 80, 500) / 4
    at, d2 = s.nearest(px, py)
    every = (px[:, None] - x) ** 2 + (py[:, None] - y) ** 2
    assert (d2 == every.min(axis=1)).all()
    assert (s.ids[at] == np.where(every == every.min(axis=1, keepdims=True), s.ids, 999).min(axis=1)).all()


def test_coarsening_by_held_centres_is_coarsening_by_joins(spark, monkeypatch):
    p = sites_of(spark, 60, 10, twice=20).drop("w")
    held = cluster.coarsened(p, 7, restarts=2).orderBy("site_id").toPandas()
    monkeypatch.setattr(cluster, "HELD_SITES", 0)
    joined = cluster.coarsened(p, 7, restarts=2).orderBy("site_id").toPandas()
    assert list(held.columns) == list(joined.columns) and held.converged.all() and held.m.sum() == pytest.approx(1)
    for c in held.columns:
        assert held[c].to_numpy() == pytest.approx(joined[c].to_numpy(), abs=1e-9)


def test_a_lloyd_step_of_a_held_raster_joins_nothing(spark, monkeypatch):
    s, over = sites_of(spark, 15, 11).withColumn("w", F.lit(0e0)), RasterDensity(BOX, raster(spark))
    joined = cluster.density_step(s, RasterDensity(BOX, raster(spark))).orderBy("site_id").toPandas()
    monkeypatch.setattr(RasterDensity, "over", None)
    assert joined.equals(cluster.density_step(s, over).orderBy("site_id").toPandas())
    monkeypatch.undo()
    monkeypatch.setattr(cluster, "HELD_SITES", 0)
    tiled = cluster.density_step(s, over).orderBy("site_id").toPandas()
    for c in tiled.columns:
        assert tiled[c].to_numpy() == pytest.approx(joined[c].to_numpy(), abs=1e-9)


def test_greedy_rounds_do_not_count_the_sinks_that_a_source_fills(spark, monkeypatch):
    rounds, kept = [], greedy._kept
    monkeypatch.setattr(greedy, "_kept", lambda *a: rounds.append(1) or kept(*a))
    rows = [(0, 0.0, 0.0, 0.5), *((k, float(k), 0.0, -0.0125) for k in range(1, 41))]
    got = greedy.greedy_moves(spark.createDataFrame(rows, "site_id long, x double, y double, g double")).toPandas()
    assert sorted(got.sink) == list(range(1, 41)) and got.m.sum() == pytest.approx(0.5) and len(rounds) <= 3


@pytest.mark.parametrize("n, bucket", [(1, 8), (7, 1), (9, 8), (300, 8), (300, 1)])
def test_greedy_tree_gives_the_nearest_sinks_with_room(monkeypatch, n, bucket):
    monkeypatch.setattr(greedy, "BUCKET", bucket)
    r = np.random.default_rng(n + bucket)
    ids, x, y, room = r.permutation(n) - 3, r.integers(0, 9, n) / 3, r.integers(0, 5, n) / 3, r.integers(1, 9, n)
    tree, left = greedy.Sinks(ids, x, y, room), dict(zip(ids.tolist(), room.tolist(), strict=True))
    where = dict(zip(ids.tolist(), zip(x, y, strict=True), strict=True))
    for _ in range(n):
        a, b, mass, want = *r.random(2) * 4, int(r.integers(1, 12)), []
        whole = mass
        for d2, i in sorted(((a - u) * (a - u) + (b - v) * (b - v), i) for i, (u, v) in where.items() if left[i]):
            moved = min(mass, left[i])
            if moved:
                want.append((i, moved, d2))
            mass, left[i] = mass - moved, left[i] - moved
        assert list(tree.filled(a, b, whole)) == want


def test_coordinate_steps_of_nearly_collinear_sites_are_few():
    r = np.random.default_rng(6)
    x, y, goals = np.sort(20 + 7 * r.random(25)), 5 + 0.3 * r.random(25), np.full(25, 490 / 25)
    w, free, rounds = np.r_[0.0, np.full(24, -5002.0)], np.arange(1, 25), 0
    s = cells.Sites(np.arange(25) + 7, x, y, w, cells.DOMAIN)
    lack = 1.0
    while lack > 1e-7 * 490 and rounds < 60:
        now, more = s.raised(free, goals[free], 490 / 25)
        assert (now <= goals[free] * (1 + 1e-9)).all() and (more >= s.w[free]).all()
        s.w[free], lack, rounds = more, (goals[free] - now).max(), rounds + 1
        s.w_max = float(s.w.max())
    assert lack <= 1e-7 * 490  # each weight by itself takes thousands of rounds
