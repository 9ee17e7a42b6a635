import math
import os
import random
import tempfile
from functools import partial

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from massflow.functions import geometry as G
from massflow.jobs.registry import ORACLES, QUERIES
from massflow.operators import assign, cells, cluster, density, greedy, interpolate, measure, objective, solvers
from massflow.operators.assign import assigned
from massflow.operators.cells import Sites, cell_edges, power_cells, uniform_cell_moments
from massflow.operators.densities import RasterDensity, UniformDensity
from massflow.operators.search import backtracked, searched
from massflow.sources import fixtures, formats

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same_rows(df, c, sql):
    r = c.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: tuple((v is None, round(v, 5) if isinstance(v, float) else v) for v in row)
    assert sorted(key(x) for x in df.select(*cols).collect()) == sorted(key(x) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


def random_sites(spark, n, seed, weights=2.0):
    rng = np.random.default_rng(seed)
    rows = [(i, float(x), float(y), 1 / n, float(w)) for i, (x, y, w) in enumerate(zip(rng.uniform(0, 49, n), rng.uniform(0, 10, n), rng.uniform(0, weights, n)))]
    return spark.createDataFrame(rows, "site_id long, x double, y double, m double, w double")


def cells_by_clipping(sites, domain=fixtures.DOMAIN):
    """(site_id, vs) by column expressions alone: every cell is cut by every bisector."""
    halves = F.struct(
        (2 * (F.col("q.x") - F.col("p.x"))).alias("a"),
        (2 * (F.col("q.y") - F.col("p.y"))).alias("b"),
        (F.col("q.x") ** 2 + F.col("q.y") ** 2 - F.col("p.x") ** 2 - F.col("p.y") ** 2 + F.col("p.w") - F.col("q.w")).alias("c"),
    )
    pairs = sites.alias("p").join(F.broadcast(sites).alias("q"), F.col("p.site_id") != F.col("q.site_id"), "left")
    grouped = pairs.groupBy(F.col("p.site_id").alias("site_id")).agg(F.collect_list(F.when(F.col("q.site_id").isNotNull(), halves)).alias("halves"))
    box = F.array(*(G.point(F.lit(float(a)), F.lit(float(b))) for a, b in domain))
    return grouped.select("site_id", G.cut_all(box, F.col("halves")).alias("vs"))


def test_cells_tile_the_domain_and_agree_with_clipping_by_expressions(spark):
    s = random_sites(spark, 40, 1)
    a = {r[0]: r[1] for r in power_cells(s).select("site_id", G.area(F.col("vs"))).collect()}
    b = {r[0]: r[1] for r in cells_by_clipping(s).select("site_id", G.area(F.col("vs"))).collect()}
    assert sum(a.values()) == pytest.approx(490, abs=1e-9)
    assert a == pytest.approx(b, abs=1e-8)


@pytest.mark.parametrize("rows", [[(1, 5.0, 5.0)], [(1, 5.0, 5.0), (2, 9.0, 5.0)], [(i, 5.0 * i, 5.0) for i in range(1, 6)], [(1, 5.0, 5.0), (2, 5.0, 5.0)]])
def test_one_two_collinear_and_coincident_sites(spark, rows):
    s = spark.createDataFrame([(*r, 0.2, 0.0) for r in rows], "site_id long, x double, y double, m double, w double")
    areas = [r[0] for r in power_cells(s).select(G.area(F.col("vs"))).collect()]
    assert len(areas) == len(rows) and sum(areas) == pytest.approx(490)


@pytest.mark.parametrize("n", [60, 200])
def test_assignment_is_the_nearest_of_all(spark, n):
    s = random_sites(spark, n, 2, weights=9.0)
    p = random_sites(spark, 500, 3).select(F.col("site_id").alias("pid"), "x", "y", "m")
    got = {r["pid"]: r["site_id"] for r in assigned(p, s).collect()}
    sites = s.toPandas()
    for r in p.toPandas().itertuples():
        power = (sites.x - r.x) ** 2 + (sites.y - r.y) ** 2 - sites.w
        assert got[r.pid] == sites.site_id[power.idxmin()]


@pytest.mark.parametrize(("n", "weight"), [(300, 0.0), (1200, 1e-8)])
def test_lists_grow_with_sites_and_squares_where_sites_are_clustered(spark, n, weight):
    draw = np.random.default_rng(n)
    xy, w = draw.random((n, 2)) * 0.01 + (20, 5), draw.random(n) * weight
    xy[1], w[1] = xy[0], w[0]  # coincident sites: the smaller id wins
    sites = spark.createDataFrame(pd.DataFrame({"site_id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "w": w}))
    at = np.vstack([draw.random((300, 2)) * (49, 10), xy[:200] + draw.normal(size=(200, 2)) * 1e-4, xy[:2]])
    p = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(at)), "qx": 7, "near": "a", "x": at[:, 0], "y": at[:, 1]}))
    odd = spark.createDataFrame([(-1, 7, "a", None, 1.0)], p.schema)
    rows = assign.assigned(p.union(odd), sites.union(spark.createDataFrame([(n, None, 1.0, 9.0)], sites.schema))).toPandas().sort_values("k")
    power = ((at[:, None] - xy[None]) ** 2).sum(2) - w
    assert list(rows.columns) == ["k", "qx", "near", "x", "y", "site_id", "d2"] and list(rows.k) == list(range(len(at)))
    assert (rows.site_id.to_numpy() == power.argmin(1)).all()
    distinct = sites.where("site_id != 1")
    lists, last = assign._lists(distinct, assign._box(p, distinct)[0])
    got = lists.agg(F.count("*").alias("squares"), F.sum(F.size("near")).alias("entries"), F.sum(F.expr("pow(16, -k)")).alias("area"), F.max("k").alias("k")).first()
    assert got["entries"] <= 5 * (n + got["squares"]) and got["squares"] <= 6 * n
    assert got["area"] == pytest.approx(1, rel=1e-12) and got["k"] <= last


def test_tied_points_go_to_the_smallest_site(spark):
    s = spark.createDataFrame([(7, 0.0, 0.0, 0.0), (3, 2.0, 0.0, 0.0)], "site_id long, x double, y double, w double")
    p = spark.createDataFrame([(1.0, 0.0), (1.0, 5.0)], "x double, y double")
    assert {r["site_id"] for r in assigned(p, s).collect()} == {3}
    assert assigned(p, s.limit(0)).count() == 0


def test_gradient_is_the_derivative_and_shifts_change_nothing(spark):
    f = solvers.Uniform(random_sites(spark, 12, 4))
    w = np.random.default_rng(5).uniform(0, 1, 12)
    f0, g, _ = f(w)
    step = np.eye(12)[3] * 1e-4
    assert (f(w + step)[0] - f(w - step)[0]) / 2e-4 == pytest.approx(g[3], abs=1e-6)
    assert f(w + 5)[0] == pytest.approx(f0, abs=1e-9)
    assert g.sum() == pytest.approx(0, abs=1e-9)


def test_solvers_meet_the_masses(spark):
    f = solvers.Uniform(random_sites(spark, 9, 6))
    a = solvers.lbfgs(f, np.zeros(9), solvers.norm_inf(1e-7))
    b = solvers.newton(f, np.zeros(9), solvers.norm_inf(1e-9))
    assert np.abs(f(a)[1]).max() <= 1e-6 and np.abs(f(b)[1]).max() <= 1e-8
    assert a == pytest.approx(b, abs=1e-2)


def test_hessian_is_the_gradients_derivative(spark):
    f = solvers.Uniform(random_sites(spark, 8, 7))
    w = np.zeros(8)
    h, step = f.hessian(w), np.eye(8)[2] * 1e-5
    assert (f(w + step)[1] - f(w - step)[1]) / 2e-5 == pytest.approx(h @ np.eye(8)[2], abs=1e-5)
    assert h @ np.ones(8) == pytest.approx(np.zeros(8), abs=1e-12) and (h.diagonal() > 0).all()


def test_coverage_sums_to_the_area_and_segments_to_their_length(spark):
    p = fixtures.polygons(spark, SF)
    c = density.coverage(p, "poly_id").groupBy("poly_id").agg(F.sum("cov").alias("c"), F.max("cov").alias("m"))
    for r in c.join(p.select("poly_id", G.area(F.col("vs")).alias("a")), "poly_id").collect():
        assert r["c"] == pytest.approx(r["a"], abs=1e-9) and r["m"] <= 1 + 1e-9
    s = fixtures.segments(spark, SF)
    got = density.segment_pixels(s, "seg_id").groupBy("seg_id").agg(F.sum("len").alias("l"))
    for r in got.join(s, "seg_id").collect():
        assert r["l"] == pytest.approx(math.hypot(r["x1"] - r["x0"], r["y1"] - r["y0"]), abs=1e-9)


def test_running_sums_over_many_ranges(spark):
    df = spark.range(1000).select("id", F.lit(1.0).alias("m"))
    got = {r["id"]: r["cdf"] for r in measure.running(df, F.col("id"), "m", width=64).collect()}
    assert all(got[i] == i + 1 for i in range(1000))


def test_lloyd_lowers_the_energy_and_levels_keep_mass_and_barycentre(spark):
    p = random_sites(spark, 80, 8).drop("w")
    h = cluster.decomposed(p, levels=3, ratio=4, restarts=2, max_steps=5).toPandas()
    for _, level in h.groupby("level"):
        assert level.m.sum() == pytest.approx(1)
        assert (level.m * level.x).sum() == pytest.approx((h[h.level == 0].m * h[h.level == 0].x).sum())
    c = random_sites(spark, 6, 9)
    energies = []
    for _ in range(3):
        energies.append(cluster.lloyd_energy(p.drop("site_id"), c).first()["energy"])
        c = cluster.lloyd_step(p.drop("site_id"), c)
    assert energies == sorted(energies, reverse=True)


def walked(rows):
    """The greedy walk, a source after another: (source, sink) -> mass."""
    total = sum(abs(g) for *_, g in rows)
    units = [(i, x, y, round(g / total * 1e15)) for i, x, y, g in sorted(rows)]
    room, moved = {i: -u for i, _, _, u in units if u < 0}, {}
    for i, x, y, left in units:
        while left > 0 and any(room.values()):
            k = min((j for j, *_ in units if room.get(j)), key=lambda j: next(((x - a) ** 2 + (y - b) ** 2, j) for h, a, b, _ in units if h == j))
            moved[i, k] = min(left, room[k])
            left, room[k] = left - moved[i, k], room[k] - moved[i, k]
    return {k: u * total / 1e15 for k, u in moved.items()}


@pytest.mark.parametrize("leaf, even", [(64, True), (2, True), (2, False)])
def test_greedy_moves_are_those_of_the_walk(spark, monkeypatch, leaf, even):
    monkeypatch.setattr(greedy, "LEAF", leaf)
    monkeypatch.setattr(greedy, "BROADCAST_LEVELS", leaf // 32)
    r = random.Random(leaf + even)
    # ties, coincident sites, a cluster and one far away; masses that fill sinks exactly
    rows = [(3 * i, float(r.randint(0, 4)), float(r.randint(0, 2)) if i % 3 else 1e-3 * i, r.choice([-1, 1]) * (r.randint(1, 3) / 4 if even else r.random())) for i in range(26)] + [(1, 1e4, 0.0, -0.25)]
    s = spark.createDataFrame(rows, "site_id long, x double, y double, g double")
    got = {(m["source"], m["sink"]): m["m"] for m in greedy.greedy_moves(s).collect()}
    assert got == pytest.approx(walked(rows), abs=1e-14)


@pytest.mark.parametrize("held, leaf, bucket, most", [(10**6, 64, 8, 0), (10**6, 64, 1, 0), (12, 2, 2, None), (0, 2, 8, None)])
def test_greedy_walk_takes_no_rounds_and_rounds_end_with_it(spark, monkeypatch, held, leaf, bucket, most):
    rounds, kept = [], greedy._kept
    for name, value in (("HELD_SITES", held), ("LEAF", leaf), ("BUCKET", bucket), ("BROADCAST_LEVELS", 1), ("_kept", lambda *a: rounds.append(1) or kept(*a))):
        monkeypatch.setattr(greedy, name, value)
    r = random.Random(5)
    # sources that come later stand nearer, so that they are displaced one after another; ties and coincident sites beside them
    rows = [(i, 20.0 - i, 0.0, 0.5) for i in range(14)] + [(20 + i, -float(i), 0.0, -0.5) for i in range(14)]
    rows += [(40 + i, float(r.randint(0, 3)), float(r.randint(5, 7)), r.choice([-1, 1]) * r.randint(1, 3) / 4) for i in range(16)]
    s = spark.createDataFrame(r.sample(rows, len(rows)), "site_id long, x double, y double, g double")
    got = greedy.greedy_moves(s).collect()
    assert {(m["source"], m["sink"]): m["m"] for m in got} == pytest.approx(walked(rows), abs=1e-14)
    place = {i: (x, y) for i, x, y, _ in rows}
    assert all(m["d2"] == pytest.approx(math.dist(place[m["source"]], place[m["sink"]]) ** 2) for m in got)
    assert len(rounds) == most if most is not None else rounds


def test_greedy_bound_of_few_sites(spark):
    kind = "site_id long, x double, y double, g double, sink int, room string"
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 1, "a"), (2, 3.0, 0.0, -0.2, 1, "a"), (3, 0.0, 4.0, -0.3, 1, "a"), (4, None, 0.0, 0.5, 1, "a"), (5, 1.0, 1.0, None, 1, "a"), (6, 1.0, 1.0, 0.0, 1, "a")], kind)
    assert objective.greedy_bound(s) == pytest.approx(math.sqrt(0.2 * 9 + 0.3 * 16))
    assert objective.greedy_bound(s.where("g > 0")) == objective.greedy_bound(s.where("g < 0")) == objective.greedy_bound(s.limit(0)) == 0


def test_formats_round_trip(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    with open(f"{d}/a.poly", "w") as f:
        f.write("0 0\n4 0\n\n4 3\n")
    with open(f"{d}/b.diracs", "w") as f:
        f.write("1 2 0.5\n3 4 1.5\n")
    with open(f"{d}/c.pgm", "wb") as f:
        f.write(b"P5\n# c\n2 2\n255\n" + bytes([1, 2, 3, 4]))
    assert formats.read_any(spark, f"{d}/a.poly").select(G.area(F.col("vs"))).first()[0] == 6
    assert [(r["x"], r["m"]) for r in formats.read_any(spark, f"{d}/b.diracs").orderBy("site_id").collect()] == [(1, 0.5), (3, 1.5)]
    px = {(r["x"], r["y"]): r["v"] for r in formats.read_image(spark, f"{d}/c.pgm", invert=True).collect()}
    assert px == {(0, 1): 254, (1, 1): 253, (0, 0): 252, (1, 0): 251}
    h = fixtures.hierarchy(spark, SF)
    formats.write_hierarchy(h, f"{d}/h")
    assert formats.read_hierarchy(spark, f"{d}/h").count() == h.count()
    formats.write_dec(h, f"{d}/dec")
    lines = [r[0] for r in spark.read.text(f"{d}/dec").collect()]
    assert lines[0] == "3" and lines[1] == str(h.where("level = 2").count())
    formats.write_points(h, f"{d}/pts", "x", "y", "m")
    assert len(os.listdir(f"{d}/pts")) > 1


def test_empty_cells_and_edges(spark):
    s = spark.createDataFrame([(1, 5.0, 5.0, 0.5, 0.0), (2, 6.0, 5.0, 0.5, -100.0)], "site_id long, x double, y double, m double, w double")
    m = {r["site_id"]: r for r in uniform_cell_moments(power_cells(s), s, 490.0).collect()}
    assert m[2]["mu"] == 0 and m[2]["g"] == -0.5 and m[1]["mu"] == pytest.approx(1)
    assert cell_edges(power_cells(s)).count() == 0
    assert Sites(*(np.array([]) for _ in range(4)), fixtures.DOMAIN).grid == {}


def test_stopping_rules():
    cells = lambda w2: pd.DataFrame({"sqint": [w2 / 2, w2 / 2]})
    g = np.array([1e-8, -1e-8])
    assert solvers.norm_inf(1e-7)(g, cells(4)) and not solvers.norm_inf(1e-9)(g, cells(4))
    assert solvers.norm_p(1e-7, 2)(g, cells(4))
    assert solvers.stop_named("wasserstein-error", 0.01, 10.0)(g, cells(4))
    rough = solvers.stop_named("wasserstein-abs-error", 1e-6, 10.0)
    assert not rough(np.array([0.1, -0.1]), cells(4)) and rough.low == 0.0
    rough.quantisation = 0.5
    assert rough(g, cells(4))
    with pytest.raises(ValueError):
        solvers.stop_named("other", 1, 1)


def test_rays_and_samples_of_any_convex_polygon(spark):
    six = [(36.1, 3.2), (40.7, 1.15), (45.3, 2.4), (46.6, 6.65), (42.2, 9.1), (37.4, 7.45)]
    vs = F.array(*(G.point(F.lit(a), F.lit(b)) for a, b in six))
    n = 4000
    u = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u1"), (F.col("id") * 0.6180339887498949 % 1 + 1e-9).alias("u2"))
    p = u.withColumn("p", measure.polygon_point(vs, F.col("u1"), F.col("u2"))).select("p.x", "p.y")
    assert p.where(~G.inside(vs, F.col("x"), F.col("y"))).count() <= 2  # on an edge but for rounding
    c = p.agg(F.avg("x"), F.avg("y")).first()
    centre = spark.range(1).select(G.centroid(vs).alias("c")).first()["c"]
    assert (c[0], c[1]) == pytest.approx((centre["x"], centre["y"]), abs=0.05)
    t = spark.range(1).select(*(G.ray_in(G.rectangle(F.lit(0e0), F.lit(0e0), F.lit(4e0), F.lit(2e0)), *(F.lit(float(v)) for v in ray)).alias(str(i)) for i, ray in enumerate([(1, 1, 1, 0), (-2, 1, 1, 0), (5, 1, 1, 0), (1, 3, 1, 0), (1, 1, 0, -2)]))).first()
    assert [tuple(x) if x else None for x in t] == [(0, 3), (2, 6), None, None, (0, 0.5)]


def test_image_samples_follow_the_pixels(spark):
    px = spark.createDataFrame([(0, 0, 30), (1, 0, 0), (2, 0, 10), (3, 0, 5)], "x int, y int, v int")
    u = spark.range(9000).select(((F.col("id") + 0.5) / 9000).alias("u1"), ((F.col("id") * 77 % 100 + 0.5) / 100).alias("u2"))
    domain = G.rectangle(F.lit(0e0), F.lit(0e0), F.lit(3e0), F.lit(1e0))
    got = measure.image_sample(u, px, domain, 4)
    by = {r[0]: r[1] for r in got.groupBy(F.floor("x")).count().collect()}
    assert by == {0: 6000, 2: 2000}
    assert got.where("x < 1").agg(F.avg("x")).first()[0] == pytest.approx(0.5, abs=1e-3)


def test_draws_at_the_end_of_rounded_sums_are_kept(spark):
    m = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.5), (2, 1.0, 1.0, 0.4999, 0.9999)], "site_id long, x double, y double, m double, cdf double")
    u = spark.createDataFrame([(1, 0.99999), (2, 0.5), (3, 1.0)], "k long, u double")
    assert sorted((r["k"], r["site_id"]) for r in measure.inverse_cdf(u, m, "u").collect()) == [(1, 2), (2, 1), (3, 2)]


def test_raster_cells_share_out_the_raster_and_its_gradient_is_the_derivative(spark):
    s = random_sites(spark, 7, 21)
    f = solvers.Raster(s, pixels=fixtures.pixels(spark, SF))
    w = np.random.default_rng(2).uniform(0, 1, 7)
    f0, g, _ = f(w)
    step = np.eye(7)[2] * 1e-3
    assert (f(w + step)[0] - f(w - step)[0]) / 2e-3 == pytest.approx(g[2], abs=1e-5)
    assert g.sum() == pytest.approx(0, abs=1e-9)
    assert np.abs(f(solvers.lbfgs(f, np.zeros(7), solvers.norm_inf(1e-5)))[1]).max() <= 1e-5


ARMIJO = partial(backtracked, conditions="armijo")


@pytest.mark.parametrize("solve", [solvers.lbfgs, partial(solvers.lbfgs, pinned=True), partial(solvers.lbfgs, search=ARMIJO), partial(solvers.lbfgs, search=backtracked), solvers.gradient_descent, solvers.subgradient, solvers.newton, solvers.coordinate])
def test_every_solver_reaches_the_goal(spark, solve):
    f = solvers.Uniform(random_sites(spark, 6, 31))
    w = solve(f, np.zeros(6), solvers.norm_inf(1e-6))
    assert np.abs(f(w)[1]).max() <= 1e-6


def test_each_step_of_lbfgs_meets_the_strong_conditions(spark):
    f, met = solvers.Uniform(random_sites(spark, 12, 33)), []

    def watched(along, start, t):
        got = searched(along, start, t)
        met.append(got.meets(start, "strong-wolfe"))
        return got

    free = solvers.lbfgs(f, np.zeros(12), solvers.norm_inf(1e-6), search=watched)
    assert met and all(met)
    held = solvers.lbfgs(f, np.zeros(12), solvers.norm_inf(1e-6), pinned=True)
    assert held[-1] == 0 and free.mean() == pytest.approx(0, abs=1e-12)
    assert held - held.mean() == pytest.approx(free, abs=1e-2)


def test_log_brackets_the_distance(spark):
    f = solvers.Uniform(random_sites(spark, 6, 32))
    known = solvers.newton(f, np.zeros(6), solvers.norm_inf(1e-10))
    log = solvers.Log(50.0, known)
    solvers.lbfgs(f, np.zeros(6), solvers.norm_inf(1e-7), log=log)
    rows = log.frame(spark).orderBy("iteration").toPandas()
    w = float(np.sqrt(f(known)[2]["sqint"].sum()))
    assert (rows.wmin <= w + 1e-6).all() and (rows.wmax >= w - 1e-6).all()
    assert rows.wmin.is_monotonic_increasing and rows.wmax.is_monotonic_decreasing and rows.seconds.is_monotonic_increasing
    assert rows.distance.iloc[-1] < 1e-2 < rows.distance.iloc[0] and rows.werr.iloc[-1] < rows.werr.iloc[0]


def test_error_bound_is_the_lesser_one(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.5), (2, 3.0, 0.0, -0.2), (3, 0.0, 4.0, -0.3)], "site_id long, x double, y double, g double")
    assert objective.error_bound(s) == pytest.approx(min(objective.greedy_bound(s), math.sqrt(0.5) * 5))


def test_gradient_of_lloyds_energy_is_its_derivative(spark):
    p, c = random_sites(spark, 200, 41).select("x", "y", "m"), random_sites(spark, 5, 42)
    g = {r["site_id"]: r for r in cluster.lloyd_gradient(p, c).collect()}
    energy = lambda h: cluster.lloyd_energy(p, c.withColumn("x", F.col("x") + F.when(F.col("site_id") == 3, h).otherwise(0.0))).first()["energy"]
    assert (energy(1e-5) - energy(-1e-5)) / 2e-5 == pytest.approx(g[3]["gx"], abs=1e-4)
    assert sum(r["energy"] for r in g.values()) == pytest.approx(energy(0.0))


def test_one_frame_is_the_start(spark):
    s = random_sites(spark, 4, 51)
    cells = power_cells(s).join(s, "site_id")
    assert {r["t"] for r in interpolate.displaced(cells, 1).collect()} == {0.0}
    assert {r["t"] for r in interpolate.morphed(s, 1, 1.0, 1.0, 490.0).collect()} == {0.0}


def test_levels_of_a_density_share_out_its_mass(spark):
    domain = [(0.0, 0.0), (6.0, 0.0), (7.0, 3.0), (0.0, 4.0)]
    h = cluster.decomposed_density(spark, UniformDensity(domain), 3, 4, threshold=0.05).toPandas()
    assert h.groupby("level").size().to_dict() == {0: 16, 1: 4, 2: 1}
    vs = F.array(*(G.point(F.lit(a), F.lit(b)) for a, b in domain))
    c = spark.range(1).select(G.centroid(vs).alias("c")).first()["c"]
    for _, level in h.groupby("level"):
        assert level.m.sum() == pytest.approx(1) and (level.m > 0).all()
        assert (level.m * level.x).sum() == pytest.approx(c["x"], abs=0.05) and (level.m * level.y).sum() == pytest.approx(c["y"], abs=0.05)
    for r in h[h.level < 2].itertuples():
        up = h[h.level == r.level + 1].set_index("site_id")
        d2 = (up.x - r.x) ** 2 + (up.y - r.y) ** 2
        assert d2[r.parent_id] == pytest.approx(d2.min())


def clustered_sites(spark, n, seed, heavy=0.0):
    """Sites of which most lie in a small spot, some at one x, and one is heavy."""
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 49, n), rng.uniform(0, 10, n)
    x[: n // 2], y[: n // 2] = 7 + 0.01 * rng.uniform(0, 1, n // 2), 3 + 0.01 * rng.uniform(0, 1, n // 2)
    x[n // 2 : 2 * n // 3] = 30.0
    w = rng.uniform(0, 0.5, n)
    w[: n // 2] *= 1e-5
    w[-1] += heavy
    return spark.createDataFrame([(i, float(a), float(b), 1 / n, float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))], "site_id long, x double, y double, m double, w double")


@pytest.mark.parametrize(("heavy", "seed"), [(0.0, 1), (60.0, 2)])
def test_cells_are_the_same_for_any_number_of_tiles(spark, heavy, seed):
    s = clustered_sites(spark, 240, seed, heavy)
    seen = []
    for size in (10_000, 60, 4):
        cells = power_cells(s, tile_sites=size)
        area = {r[0]: r[1] for r in cells.select("site_id", F.coalesce(G.area(F.col("vs")), F.lit(0e0))).collect()}
        edges = {(r["site_id"], r["neighbour"]): r["len"] for r in cell_edges(cells).where("len > 1e-6").collect()}
        seen.append((area, edges))
    whole, by = seen[0]
    assert sum(whole.values()) == pytest.approx(490, abs=1e-7)
    assert len(whole) == 240 and (heavy == 0 or min(whole.values()) == 0)
    for area, edges in seen[1:]:
        assert area == pytest.approx(whole, abs=1e-9)
        assert edges == pytest.approx(by, abs=1e-6)
    assert power_cells(s.limit(0)).count() == 0


def test_tiles_are_even_and_hold_coincident_sites_together(spark):
    s = clustered_sites(spark, 2000, 3).unionByName(spark.createDataFrame([(5000, 30.0, 5.0, 0.0, 0.0), (5001, 30.0, 5.0, 0.0, 1.0)], "site_id long, x double, y double, m double, w double"))
    tiled = cells._tiled(s.select("site_id", "x", "y", "w"), 2002, 50).toPandas()
    assert len(tiled) == 2002 and tiled.groupby(["strip", "tile"]).size().max() <= 200
    assert tiled[tiled.site_id >= 5000].groupby(["strip", "tile"]).ngroups == 1
    areas = {r[0]: r[1] for r in power_cells(s, tile_sites=50).where("site_id >= 5000").select("site_id", F.coalesce(G.area(F.col("vs")), F.lit(0e0))).collect()}
    assert areas[5000] == 0 < areas[5001]


def small_raster(spark):
    """A raster that is dark on its left, without the last column of the domain."""
    return spark.createDataFrame([(x, y, 1 + 9 * (x >= 5) + (x * y) % 3) for x in range(11) for y in range(6) if (x, y) != (3, 3)], "x int, y int, v int")


BOX = [(0.0, 0.0), (12.0, 0.0), (12.0, 5.5), (0.0, 5.5)]


def raster_by_hand(pixels, sites, n=40):
    """mu, cx, cy and sqint of the nearest site's part, by n x n samples of each pixel."""
    out = np.zeros((len(sites), 4))
    for x, y, v in pixels:
        a, b = np.meshgrid(x + (np.arange(n) + 0.5) / n, y + (np.arange(n) + 0.5) / n)
        a, b = a.ravel(), b.ravel()
        inside = (a < 12) & (b < 5.5)
        a, b = a[inside], b[inside]
        d2 = (a[:, None] - sites[:, 0]) ** 2 + (b[:, None] - sites[:, 1]) ** 2
        k = d2.argmin(axis=1)
        for j, value in enumerate((np.ones(len(a)), a, b, d2[np.arange(len(a)), k])):
            out[:, j] += np.bincount(k, value, len(sites)) * v / n / n
    total = out[:, 0].sum()
    return out[:, 0] / total, out[:, 1] / out[:, 0], out[:, 2] / out[:, 0], out[:, 3] / total


def test_lloyds_step_for_a_raster_is_the_centroid_of_samples(spark):
    p = small_raster(spark)
    rng = np.random.default_rng(8)
    at = np.stack([rng.uniform(0, 11, 7), rng.uniform(0, 5.5, 7)], axis=1)
    c = spark.createDataFrame([(i, float(x), float(y), 0.0, 0.0) for i, (x, y) in enumerate(at)], "site_id long, x double, y double, m double, w double")
    mu, cx, cy, _ = raster_by_hand([tuple(r) for r in p.collect()], at)
    got = cluster.density_step(c, RasterDensity(BOX, p)).orderBy("site_id").toPandas()
    assert got.m.to_numpy() == pytest.approx(mu, abs=3e-3) and got.x.to_numpy() == pytest.approx(cx, abs=2e-2) and got.y.to_numpy() == pytest.approx(cy, abs=2e-2)
    lone = spark.createDataFrame([(0, 11.9, 0.5, 0.0, 0.0), (1, 3.0, 3.0, 0.0, 0.0)], c.schema)
    none = RasterDensity(BOX, p.where("x < 5"))
    assert cluster.density_step(lone, none).where("site_id = 0").select("x", "y", "m").first() == (11.9, 0.5, 0.0), "a centre without mass stays"


def test_quantised_raster_lowers_the_energy_and_tells_whether_it_came_to_rest(spark):
    d = RasterDensity(BOX, small_raster(spark))
    start = d.drawn(spark, 12, seed=3)
    places = start.toPandas()
    assert len(places) == 12 and places.x.between(0, 12).all() and places.y.between(0, 5.5).all() and (d.drawn(spark, 400).where("x < 5").count() / 400) == pytest.approx(0.16, abs=0.08)
    pixels, energies = [tuple(r) for r in d.pixels.collect()], []
    for steps in (0, 1, 30):
        q = cluster.quantised(spark, d, 12, seed=3, threshold=0.1, max_steps=steps).orderBy("site_id").toPandas()
        energies.append(raster_by_hand(pixels, q[["x", "y"]].to_numpy())[3].sum())
        assert (q.converged == (steps == 30)).all()
    assert energies == sorted(energies, reverse=True) and q.m.sum() == pytest.approx(1)
    assert (q.move <= 0.1).all() and (q.steps < 30).all()


def test_levels_of_a_raster_share_out_its_mass(spark):
    d = RasterDensity(BOX, small_raster(spark))
    h = cluster.decomposed_density(spark, d, 3, 4, threshold=0.15).toPandas()
    sizes = h.groupby("level").size().to_dict()
    assert sizes[2] == 1 and sizes[1] == 4 and 10 <= sizes[0] <= 16 and h.converged.all()
    mu, cx, cy, _ = raster_by_hand([tuple(r) for r in d.pixels.collect()], np.array([[6.0, 3.0]]))
    for _, level in h.groupby("level"):
        assert level.m.sum() == pytest.approx(1) and (level.m > 0).all()
        assert (level.m * level.x).sum() == pytest.approx(cx[0], abs=0.15) and (level.m * level.y).sum() == pytest.approx(cy[0], abs=0.15)
    for r in h[h.level < 2].itertuples():
        up = h[h.level == r.level + 1].set_index("site_id")
        d2 = (up.x - r.x) ** 2 + (up.y - r.y) ** 2
        assert d2[r.parent_id] == pytest.approx(d2.min())
    level = cluster.quantised(spark, d, 20, threshold=0.5).where("m > 0").select("site_id", "x", "y", "m")
    up = cluster.decomposed(level, 2, 5, restarts=2).toPandas()
    assert up.groupby("level").size().to_dict() == {0: 20, 1: 4} and up[up.level == 0].converged.all()


def test_coarsening_takes_the_best_of_its_starts(spark):
    p = random_sites(spark, 30, 11).drop("w")
    best = cluster.coarsened(p, 5, restarts=3)
    alone = [r.select("energy").first()[0] for r in (cluster.coarsened(p, 5), best)]
    assert alone[1] <= alone[0] and best.select("converged").first()[0]
    again = cluster.lloyd_step(p.drop("site_id"), best)
    assert again.agg(F.max("move")).first()[0] < 1e-7, "centres rest at their points' centroid"
    assert cluster.lloyd_energy(p.drop("site_id"), best).first()["energy"] == pytest.approx(alone[1])
    with pytest.raises(ValueError):
        cluster.coarsened(p.limit(0), 5)


def test_multiscale_begins_where_no_cell_is_hidden(spark):
    got = solvers.multiscale(fixtures.hierarchy(spark, SF), solvers.norm_inf(1e-6), solve=solvers.newton).toPandas()
    assert got.converged.all() and got.evaluations.max() <= 20
    f = solvers.Uniform(random_sites(spark, 30, 5))
    w = solvers.unhidden(f, np.where(np.arange(30) < 15, 400.0, 0.0))
    assert (f(w)[2]["mu"] > 0).all() and f.evaluations <= 12


def test_multiscale_shares_out_a_raster_by_newtons_steps(spark):
    rows = [(0, 1, 1.0, 1.0, 0.1, 1), (0, 2, 4.0, 4.0, 0.2, 1), (0, 3, 8.0, 1.0, 0.2, 2), (0, 4, 8.5, 4.5, 0.3, 2), (0, 5, 11.0, 2.0, 0.2, 2), (1, 1, 3.0, 3.0, 0.3, None), (1, 2, 9.0, 2.5, 0.7, None)]
    hier = spark.createDataFrame(rows, "level int, site_id long, x double, y double, m double, parent_id long")
    got = solvers.multiscale(hier, solvers.norm_inf(1e-6), density=RasterDensity(BOX, small_raster(spark)), solve=solvers.newton).toPandas()
    assert got.converged.all() and set(got.level) == {0, 1} and np.isfinite(got.w2).all() and got.evaluations.max() <= 20


def test_hessian_of_a_raster_is_the_gradients_derivative(spark):
    f = solvers.Objective(random_sites(spark, 5, 7).withColumns({"x": F.col("x") / 5, "y": F.col("y") / 2}), RasterDensity(BOX, small_raster(spark)))
    w, step = np.zeros(5), np.eye(5)[2] * 1e-5
    h = f.hessian(w)
    assert (f(w + step)[1] - f(w - step)[1]) / 2e-5 == pytest.approx(h @ np.eye(5)[2], abs=1e-5)
    assert h @ np.ones(5) == pytest.approx(np.zeros(5), abs=1e-12)
