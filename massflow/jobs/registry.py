"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from massflow.jobs import oracles, queries

NAMES = """power_assignment_mass nearest_site lloyd_energy lloyd_step lloyd_step_clean coarsen_masses measure_normalize
measure_bbox_diameter dirac_cdf inverse_cdf_sample triangle_sample polygon_sample hier_ancestor hier_prolong_weights
hier_wasserstein hier_rollup_mass image_total_mass image_avg_gray image_invert image_cdf polygon_area_bbox uniform_moments
segment_integral rect_pixel_coverage rect_image_moments convex_pixel_coverage polygon_image_mass image_sqdist_integral
convex_clip_area segment_raster_length segment_image_mass segment_clip laguerre_cell_moments laguerre_hidden laguerre_edges
hessian_entries objective_value gradient_norms misaffected_mass trivial_error_bound objective_uniform
greedy_wasserstein_bound solve_lbfgs solve_pinned solve_gradient solve_subgradient solve_newton solve_coordinate multiscale_wasserstein iteration_log
kmeans_density decompose_levels displacement_interpolation cell_morph level_view_gray random_domain_points image_sample
ray_clip rect_touched_pixels lloyd_energy_gradient weights_distance displacement_arrows laguerre_image_mass solve_image
objective_image decompose_density lloyd_image_step kmeans_image decompose_image decompose_raster multiscale_image""".split()

QUERIES = {name: getattr(queries, name) for name in NAMES}
ORACLES = oracles.SQL
