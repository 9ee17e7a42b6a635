"""The registered queries of the transport library: each runs an operator over its whole tables."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.functions import geometry as G
from massflow.operators import cluster, density, greedy, hierarchy, interpolate, measure, objective, solvers
from massflow.operators.assign import assigned, cell_masses
from massflow.operators.cells import cell_edges, power_cells, uniform_cell_moments
from massflow.operators.densities import RasterDensity, UniformDensity
from massflow.sources import fixtures as X
from massflow.sources.store import stored

AREA = 490.0
FRAMES = 11


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """``columns`` rounded, and no negative zero, so that engines can be compared."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0e0 for c in columns})


def power_assignment_mass(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cell_masses(X.points(spark, d), X.sites(spark, d)).select("site_id", "mu", "g"), "mu", "g")


def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assigned(X.points(spark, d), X.sites(spark, d), weighted=False).select("pid", "site_id", "d2"), "d2")


def lloyd_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.lloyd_energy(X.points(spark, d), X.sites(spark, d)), "energy")


def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.lloyd_step(X.points(spark, d), X.sites(spark, d)).drop("w"), "x", "y", "m", "move")


def lloyd_step_clean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.lloyd_step(X.points(spark, d), X.sites(spark, d), clean=True).drop("w"), "x", "y", "m", "move")


def coarsen_masses(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' masses gathered at the nearest nation's centre."""
    above = X.hierarchy(spark, d).where("level = 1").withColumn("w", F.lit(0e0))
    below = X.sites(spark, d).select("x", "y", "m")
    return rounded(assigned(below, above, weighted=False).groupBy("site_id").agg(F.sum("m").alias("m"), F.count("*").alias("n")), "m")


def measure_normalize(spark: SparkSession, d: str) -> DataFrame:
    o = X.read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_totalprice").cast("double").alias("m"))
    return rounded(measure.normalised(o), "m", digits=12)


def measure_bbox_diameter(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    box = p.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    b = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return rounded(box.select(*b, F.hypot(b[2] - b[0], b[3] - b[1]).alias("diameter"), G.clamp_radius(*b).alias("clamp_radius")), "x0", "y0", "x1", "y1", "diameter", "clamp_radius")


def dirac_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(measure.running(X.sites(spark, d), F.col("site_id"), "m").select("site_id", "m", "cdf"), "m", "cdf", digits=9)


def inverse_cdf_sample(spark: SparkSession, d: str) -> DataFrame:
    s = measure.running(X.sites(spark, d), F.col("site_id"), "m").select("site_id", "x", "y", "m", "cdf")
    return rounded(measure.inverse_cdf(X.uniforms(spark, d), s, "u1").select("k", "site_id", "x", "y"), "x", "y")


def triangle_sample(spark: SparkSession, d: str) -> DataFrame:
    ends = [F.lit(v) for v in (2.25, 1.35, 17.6, 2.15, 8.4, 8.85)]
    x, y = measure.triangle_point(F.col("u1"), F.col("u2"), *ends)
    return rounded(X.uniforms(spark, d).select("k", x.alias("x"), y.alias("y")), "x", "y")


def polygon_sample(spark: SparkSession, d: str) -> DataFrame:
    """A point of each polygon."""
    u = X.uniforms(spark, d).select(F.col("k").alias("poly_id"), "u1", "u2")
    p = X.polygons(spark, d).join(u, "poly_id").withColumn("p", measure.polygon_point(F.col("vs"), F.col("u1"), F.col("u2")))
    return rounded(p.select("poly_id", "p.x", "p.y", G.inside(F.col("vs"), F.col("p.x"), F.col("p.y")).alias("inside")), "x", "y")


def _domain() -> Column:
    return F.array(*(G.point(F.lit(a), F.lit(b)) for a, b in X.DOMAIN))


def random_domain_points(spark: SparkSession, d: str) -> DataFrame:
    u = X.uniforms(spark, d).withColumn("p", measure.polygon_point(_domain(), F.col("u1"), F.col("u2")))
    return rounded(u.select("k", "p.x", "p.y"), "x", "y")


def image_sample(spark: SparkSession, d: str) -> DataFrame:
    """Places drawn from the raster, those strictly inside the domain."""
    return rounded(measure.image_sample(X.uniforms(spark, d), X.pixels(spark, d), _domain(), 50).select("k", "x", "y"), "x", "y", digits=5)


def hier_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(X.hierarchy(spark, d), 0, 2)


def hier_prolong_weights(spark: SparkSession, d: str) -> DataFrame:
    h = X.hierarchy(spark, d)
    w = h.where("level = 2 and site_id < 4").select("site_id", (F.col("site_id") * 0.5 + 1e0).alias("w"))
    return hierarchy.prolonged(h, w, 0, 2)


def hier_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    h = X.hierarchy(spark, d)
    parts = [hierarchy.transport_distance(h, a, b) for a, b in ((0, 1), (0, 2), (1, 2))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "w2")


def hier_rollup_mass(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hierarchy.rolled_up(X.hierarchy(spark, d)), "m", "child_m", digits=9)


def image_total_mass(spark: SparkSession, d: str) -> DataFrame:
    return X.pixels(spark, d).agg(F.sum("v").alias("total"), F.count("*").alias("n_pixels"), F.max("v").alias("top"))


def image_avg_gray(spark: SparkSession, d: str) -> DataFrame:
    p = X.pixels(spark, d).agg(F.sum("v").alias("total"), ((F.max("x") + 1) * (F.max("y") + 1)).cast("long").alias("area"))
    return rounded(p.select("total", "area", (F.col("total") / F.col("area")).alias("avg_gray")), "avg_gray")


def image_invert(spark: SparkSession, d: str) -> DataFrame:
    return X.pixels(spark, d).select("x", "y", (255 - F.col("v")).alias("v"))


def image_cdf(spark: SparkSession, d: str) -> DataFrame:
    p = X.with_total(X.pixels(spark, d), total=F.sum("v")).withColumn("part", F.col("v") / F.col("total"))
    return rounded(measure.running(p, F.col("y") * 50 + F.col("x"), "part").select("x", "y", "cdf"), "cdf", digits=9)


def polygon_area_bbox(spark: SparkSession, d: str) -> DataFrame:
    b = G.bounds(F.col("vs"))
    return rounded(X.polygons(spark, d).select("poly_id", G.area(F.col("vs")).alias("area"), *(b[c].alias(c) for c in ("x0", "y0", "x1", "y1"))), "area", "x0", "y0", "x1", "y1")


def uniform_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(density.uniform_moments(X.polygons(spark, d), "poly_id", AREA), "mass", "cx", "cy", "sqint", digits=9)


def segment_integral(spark: SparkSession, d: str) -> DataFrame:
    return rounded(density.segment_integrals(X.segments(spark, d), "seg_id", AREA), "mass", "sqint")


def _rect_polygons(spark: SparkSession, d: str) -> DataFrame:
    return X.rectangles(spark, d).select("rect_id", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("vs"))


def rect_pixel_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(density.coverage(_rect_polygons(spark, d), "rect_id").where("cov > 1e-9"), "cov")


def rect_touched_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that each rectangle covers anything of, counted whole."""
    c = density.coverage(_rect_polygons(spark, d), "rect_id", exact=False)
    return c.groupBy("rect_id").agg(F.count("*").alias("n"), F.sum("cov").alias("area"))


def rect_image_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(density.image_moments(_rect_polygons(spark, d), X.pixels(spark, d), "rect_id").drop("n_pixels"), "mass", "cx", "cy")


def convex_pixel_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per polygon: the sum of its pixels' coverage, which must be its area."""
    c = density.coverage(X.polygons(spark, d), "poly_id")
    return rounded(c.groupBy("poly_id").agg(F.sum("cov").alias("covered")), "covered")


def polygon_image_mass(spark: SparkSession, d: str) -> DataFrame:
    return rounded(density.image_moments(X.polygons(spark, d), X.pixels(spark, d), "poly_id").drop("n_pixels"), "mass", "cx", "cy", digits=4)


def image_sqdist_integral(spark: SparkSession, d: str) -> DataFrame:
    """The raster's integral of the squared distance to the domain's middle over each rectangle."""
    far = lambda x, y: (x - 24.5) * (x - 24.5) + (y - 5e0) * (y - 5e0)
    return rounded(density.image_integral(_rect_polygons(spark, d), X.pixels(spark, d), "rect_id", far), "integral")


def convex_clip_area(spark: SparkSession, d: str) -> DataFrame:
    """Each polygon's overlap with the rectangle of the same site, by clipping."""
    r = _rect_polygons(spark, d).select(F.col("rect_id").alias("poly_id"), F.col("vs").alias("rect"))
    both = X.polygons(spark, d).join(r, "poly_id")
    return rounded(both.select("poly_id", G.area(G.intersection(F.col("vs"), F.col("rect"))).alias("area")), "area")


def segment_raster_length(spark: SparkSession, d: str) -> DataFrame:
    c = density.segment_pixels(X.segments(spark, d), "seg_id")
    return rounded(c.groupBy("seg_id").agg(F.sum("len").alias("len"), F.count("*").alias("n_pixels")), "len")


def segment_image_mass(spark: SparkSession, d: str) -> DataFrame:
    c = density.over_pixels(density.segment_pixels(X.segments(spark, d), "seg_id"), X.pixels(spark, d))
    return rounded(c.groupBy("seg_id").agg(F.sum(F.col("len") * F.col("v")).alias("mass")), "mass", digits=4)


def segment_clip(spark: SparkSession, d: str) -> DataFrame:
    """The part of each segment within the middle of the domain."""
    box = G.rectangle(F.lit(10e0), F.lit(2e0), F.lit(40e0), F.lit(8e0))
    s = X.segments(spark, d).withColumn("t", G.segment_in(box, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).where("t is not null")
    return rounded(s.select("seg_id", F.col("t.t0").alias("t0"), F.col("t.t1").alias("t1")), "t0", "t1")


def ray_clip(spark: SparkSession, d: str) -> DataFrame:
    """The part of each segment's ray within the middle of the domain."""
    box = G.rectangle(F.lit(10e0), F.lit(2e0), F.lit(40e0), F.lit(8e0))
    s = X.segments(spark, d)
    s = s.withColumn("t", G.ray_in(box, F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("t is not null")
    return rounded(s.select("seg_id", F.col("t.t0").alias("t0"), F.col("t.t1").alias("t1")), "t0", "t1")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    return uniform_cell_moments(power_cells(s), s, AREA)


def laguerre_cell_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cells(spark, d).select("site_id", "area", "cx", "cy"), "area", "cx", "cy")


def laguerre_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Weights forty times as large leave many sites without a cell."""
    heavy = X.sites(spark, d).withColumn("w", 40 * F.col("w"))
    return power_cells(heavy).where("size(vs) = 0").select("site_id")


def laguerre_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cell_edges(power_cells(X.sites(spark, d))).where("len > 1e-6"), "len")


def hessian_entries(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    return rounded(objective.hessian(cell_edges(power_cells(s)).where("len > 1e-6"), s, AREA), "h", digits=9)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return cell_masses(X.points(spark, d), X.sites(spark, d))


def objective_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(objective.value(_stats(spark, d)), "f", "w2_squared")


def gradient_norms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(objective.norms(_stats(spark, d)), "norm_1", "norm_2", "norm_p", "norm_inf")


def misaffected_mass(spark: SparkSession, d: str) -> DataFrame:
    return rounded(objective.misaffected(_stats(spark, d)), "misaffected", "excess", "lack")


def trivial_error_bound(spark: SparkSession, d: str) -> DataFrame:
    return rounded(objective.trivial_bound(_stats(spark, d)), "diameter", "bound")


def objective_uniform(spark: SparkSession, d: str) -> DataFrame:
    """The objective under the uniform density, by exact cells."""
    return rounded(objective.value(_cells(spark, d)), "f", "w2_squared")


def laguerre_image_mass(spark: SparkSession, d: str) -> DataFrame:
    """The raster's share in each power cell, and its centroid there."""
    return rounded(_image_cells(spark, d).select("site_id", "mu", "cx", "cy"), "mu", "cx", "cy", digits=5)


def _image_cells(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    return density.cell_image_moments(power_cells(s).where("size(vs) > 2").select("site_id", "vs"), s, X.pixels(spark, d))


def objective_image(spark: SparkSession, d: str) -> DataFrame:
    """The objective under the raster's density, by exact coverage of the pixels."""
    return rounded(objective.value(_image_cells(spark, d)), "f", "w2_squared", digits=5)


def lloyd_energy_gradient(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.lloyd_gradient(X.points(spark, d), X.sites(spark, d)), "energy", "gx", "gy")


def weights_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far the sites' weights are from a hundred times their masses."""
    s = X.sites(spark, d)
    return rounded(objective.distance_to(s, s.select("site_id", (100 * F.col("m")).alias("w"))), "distance", digits=9)


def greedy_wasserstein_bound(spark: SparkSession, d: str) -> DataFrame:
    """The bound, and the number of moves."""
    moved = greedy.greedy_moves(_stats(spark, d)).agg(F.sqrt(F.coalesce(F.sum(F.col("m") * F.col("d2")), F.lit(0e0))).alias("bound"), F.count("*").alias("n_moves"))
    return rounded(moved, "bound")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return X.hierarchy(spark, d).where("level = 1").select("site_id", "x", "y", "m")


GOAL = 1e-6


def _solved(f: solvers.Objective, solve, goal: float = GOAL) -> DataFrame:
    """The solver's weights and masses; ``converged`` tells whether all masses are met to the goal."""
    w = solve(f, np.zeros(f.n), solvers.norm_inf(goal))
    _, g, s = f(w)
    worst = float(np.abs(g).max())
    return f.stats(w, s).select("site_id", "w", "mu", "m", "g", F.lit(worst <= goal).alias("converged"))


def solve_lbfgs(spark: SparkSession, d: str) -> DataFrame:
    return _solved(solvers.Uniform(X.sites(spark, d)), solvers.lbfgs)


def solve_pinned(spark: SparkSession, d: str) -> DataFrame:
    """As solve_lbfgs, with the last site's weight held at 0."""
    return _solved(solvers.Uniform(X.sites(spark, d)), partial(solvers.lbfgs, pinned=True))


def solve_gradient(spark: SparkSession, d: str) -> DataFrame:
    return _solved(solvers.Uniform(_nations(spark, d)), solvers.gradient_descent)


def solve_subgradient(spark: SparkSession, d: str) -> DataFrame:
    return _solved(solvers.Uniform(_nations(spark, d)), solvers.subgradient)


def solve_newton(spark: SparkSession, d: str) -> DataFrame:
    return _solved(solvers.Uniform(X.sites(spark, d)), solvers.newton)


def solve_coordinate(spark: SparkSession, d: str) -> DataFrame:
    return _solved(solvers.Uniform(_nations(spark, d)), solvers.coordinate)


def solve_image(spark: SparkSession, d: str) -> DataFrame:
    """The weights for which the power cells share out the raster by the suppliers' masses."""
    return _solved(solvers.Raster(X.sites(spark, d), X.pixels(spark, d)), solvers.newton)


def multiscale_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return solvers.multiscale(X.hierarchy(spark, d), solvers.norm_inf(GOAL), solve=solvers.newton)


def iteration_log(spark: SparkSession, d: str) -> DataFrame:
    """The steps of the nations' solution, a row each, with the running bracket of the distance."""
    f = solvers.Uniform(_nations(spark, d))
    known = solvers.newton(f, np.zeros(f.n), solvers.norm_inf(1e-9))
    log = solvers.Log(float(np.hypot(np.ptp(f.held["x"]), np.ptp(f.held["y"]))), known)
    solvers.lbfgs(f, np.zeros(f.n), solvers.norm_inf(GOAL), log=log)
    return log.frame(spark).drop("seconds")


def kmeans_density(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans_density(X.sites(spark, d), UniformDensity())


def _raster(spark: SparkSession, d: str, corners: bool = False) -> RasterDensity:
    return RasterDensity(pixels=stored(X.pixels(spark, d), "pixels"), corners=corners)


def lloyd_image_step(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' places moved to the raster's centroid in their Voronoi cells."""
    return rounded(cluster.density_step(X.sites(spark, d), _raster(spark, d, corners=True)).select("site_id", "x", "y", "m", "move"), "x", "y", "m", "move", digits=5)


def kmeans_image(spark: SparkSession, d: str) -> DataFrame:
    """The raster quantised into as many places as there are suppliers."""
    return cluster.quantised(spark, _raster(spark, d), X.sites(spark, d).count())


def decompose_levels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.decomposed(X.sites(spark, d), levels=3, ratio=5)


def decompose_image(spark: SparkSession, d: str) -> DataFrame:
    """The raster quantised, and the places gathered in levels of a fifth of them each."""
    level = kmeans_image(spark, d).where("m > 0").select("site_id", "x", "y", "m")
    return cluster.decomposed(level, levels=3, ratio=5)


def _levels(spark: SparkSession, d: str) -> int:
    """As many levels of five times as many sites as the suppliers are worth."""
    n, levels = X.sites(spark, d).count(), 1
    while 5**levels <= n:
        levels += 1
    return levels


def decompose_density(spark: SparkSession, d: str) -> DataFrame:
    """The uniform density of the suppliers' box, in as many levels as their number is worth."""
    b = X.sites(spark, d).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    box = [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
    return cluster.decomposed_density(spark, UniformDensity(box), _levels(spark, d), 5)


def decompose_raster(spark: SparkSession, d: str) -> DataFrame:
    """The raster's own levels, from the top down."""
    return cluster.decomposed_density(spark, _raster(spark, d), _levels(spark, d), 5)


def multiscale_image(spark: SparkSession, d: str) -> DataFrame:
    """The weights that share out the raster over the hierarchy's levels, the coarsest first."""
    return solvers.multiscale(X.hierarchy(spark, d), solvers.norm_inf(GOAL), density=_raster(spark, d), solve=solvers.newton)


def displacement_interpolation(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    cells = power_cells(s).join(s, "site_id")
    return rounded(interpolate.displaced(cells, FRAMES), "t", "x", "y", "r", "gray")


def displacement_arrows(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    return rounded(interpolate.arrows(power_cells(s).join(s, "site_id")), "x", "y", "tx", "ty")


def cell_morph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(interpolate.morphed(X.sites(spark, d), 3, 128.0, 96.0, AREA), "area", "gray", digits=4)


def level_view_gray(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    return rounded(interpolate.level_gray(power_cells(s).join(s.select("site_id", "m"), "site_id"), AREA), "area", "gray", digits=5)


