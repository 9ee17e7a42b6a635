"""DuckDB SQL for the rows of the registered queries, by brute force where the operators prune."""

from __future__ import annotations

import re

from massflow.sources.fixtures import with_tables

_POWER = "arg_min({'s': s.site_id, 'd2': (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)}, {'k': (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) - %s, 's': s.site_id})"


def _assigned(points: str, key: str, sites: str, weight: str) -> str:
    return f"SELECT p.{key}, any_value(p.m) AS m, any_value(p.x) AS x, any_value(p.y) AS y, {_POWER % weight} AS a FROM {points} p CROSS JOIN {sites} s GROUP BY p.{key}"


_STATS = (
    f", a AS MATERIALIZED ({_assigned('pt', 'pid', 'site', 's.w')}), "
    "st AS (SELECT s.site_id, s.x, s.y, s.w, s.m, coalesce(t.mu, 0e0) AS mu, coalesce(t.sqint, 0e0) AS sqint, coalesce(t.mu, 0e0) - s.m AS g FROM site s LEFT JOIN (SELECT a.s AS site_id, sum(m) AS mu, sum(m * a.d2) AS sqint FROM a GROUP BY a.s) t USING (site_id)) "
)
_NEAR = f", a AS MATERIALIZED ({_assigned('pt', 'pid', 'site', '0e0')}), t AS (SELECT a.s AS site_id, sum(m) AS m, sum(m * x) AS mx, sum(m * y) AS my FROM a GROUP BY a.s) "
_STEP = "SELECT s.site_id, round(coalesce(mx / t.m, s.x), 6) AS x, round(coalesce(my / t.m, s.y), 6) AS y, round(coalesce(t.m, 0e0), 6) AS m, round(sqrt((coalesce(mx / t.m, s.x) - s.x) ^ 2 + (coalesce(my / t.m, s.y) - s.y) ^ 2), 6) AS move FROM site s {} t USING (site_id)"

#: Cells by enumeration: the crossings of any two boundary lines that no boundary line cuts off.
_CELLS = """, h AS MATERIALIZED (SELECT site_id, nb, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a * a + b * b) AS n FROM (
  SELECT i.site_id, j.site_id AS nb, 2 * (j.x - i.x) AS a, 2 * (j.y - i.y) AS b, j.x * j.x + j.y * j.y - i.x * i.x - i.y * i.y + i.w - j.w AS c FROM site i JOIN site j ON i.site_id <> j.site_id
  UNION ALL SELECT site_id, nb, a, b, c FROM site, (VALUES (-1, -1e0, 0e0, 0e0), (-2, 1e0, 0e0, 49e0), (-3, 0e0, -1e0, 0e0), (-4, 0e0, 1e0, 10e0)) d(nb, a, b, c)) u) z),
l AS MATERIALIZED (SELECT site_id, list({'a': a, 'b': b, 'c': c}) AS hs FROM h GROUP BY site_id),
v0 AS MATERIALIZED (SELECT p.site_id, p.nb AS n1, q.nb AS n2, (p.c * q.b - q.c * p.b) / (p.a * q.b - q.a * p.b) AS x, (p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b) AS y
  FROM h p JOIN h q ON p.site_id = q.site_id AND p.nb < q.nb WHERE abs(p.a * q.b - q.a * p.b) > 1e-12),
v AS MATERIALIZED (SELECT v0.* FROM v0 JOIN l USING (site_id) WHERE x BETWEEN -1e-6 AND 49.000001 AND y BETWEEN -1e-6 AND 10.000001
  AND len(list_filter(hs, lambda k: k.a * x + k.b * y - k.c > 1e-9)) = 0),
o AS (SELECT site_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
  FROM (SELECT *, atan2(y - avg(y) OVER (PARTITION BY site_id), x - avg(x) OVER (PARTITION BY site_id)) AS ang FROM v) z WINDOW w AS (PARTITION BY site_id ORDER BY ang ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
mo AS (SELECT site_id, sum(k) / 2 AS area, sum((x + nx) * k) / 6 AS mx, sum((y + ny) * k) / 6 AS my, sum(((x - px) * (ny - py) - (nx - px) * (y - py)) * ((x - px) * (x - px) + (x - px) * (nx - px) + (nx - px) * (nx - px) + (y - py) * (y - py) + (y - py) * (ny - py) + (ny - py) * (ny - py))) / 12 AS sq
  FROM (SELECT o.*, o.x * ny - nx * o.y AS k, s.x AS px, s.y AS py FROM o JOIN site s USING (site_id)) z GROUP BY site_id),
ed AS MATERIALIZED (SELECT site_id, nb, max(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS len FROM (SELECT site_id, n1 AS nb, x, y FROM v UNION ALL SELECT site_id, n2, x, y FROM v) a
  JOIN (SELECT site_id, n1 AS nb, x, y FROM v UNION ALL SELECT site_id, n2, x, y FROM v) b USING (site_id, nb) WHERE nb >= 0 GROUP BY site_id, nb HAVING max(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) > 1e-6)
"""
#: Coverage of rectangles: overlaps of intervals.
_COVER = """, c AS (SELECT rect_id, x, y, (least(x1, x + 1) - greatest(x0, x)) * (least(y1, y + 1) - greatest(y0, y)) AS cov
  FROM (SELECT *, unnest(range(CAST(floor(y0) AS INT), CAST(ceil(y1) AS INT))) AS y FROM (SELECT *, unnest(range(CAST(floor(x0) AS INT), CAST(ceil(x1) AS INT))) AS x FROM rect) r) q) """
#: Crossings of the grid's lines along a segment.
_CROSS = """, t AS (SELECT seg_id, x0, y0, x1, y1, list_sort(list_distinct(list_concat([0e0, 1e0],
    CASE WHEN x0 = x1 THEN [] ELSE list_transform(list_filter(range(CAST(floor(least(x0, x1)) AS INT), CAST(ceil(greatest(x0, x1)) AS INT) + 1), lambda i: i > least(x0, x1) AND i < greatest(x0, x1)), lambda i: (i - x0) / (x1 - x0)) END,
    CASE WHEN y0 = y1 THEN [] ELSE list_transform(list_filter(range(CAST(floor(least(y0, y1)) AS INT), CAST(ceil(greatest(y0, y1)) AS INT) + 1), lambda i: i > least(y0, y1) AND i < greatest(y0, y1)), lambda i: (i - y0) / (y1 - y0)) END))) AS ts FROM seg),
sp AS (SELECT seg_id, CAST(floor(x0 + (x1 - x0) * (ts[i] + ts[i + 1]) / 2) AS INT) AS x, CAST(floor(y0 + (y1 - y0) * (ts[i] + ts[i + 1]) / 2) AS INT) AS y, (ts[i + 1] - ts[i]) * sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) AS len
  FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM t) z) """
_HESSIAN = ", hs AS (SELECT i.site_id AS i, j.site_id AS j, -ed.len / 490 / (2 * sqrt((i.x - j.x) ^ 2 + (i.y - j.y) ^ 2)) AS h FROM ed JOIN site i USING (site_id) JOIN site j ON j.site_id = ed.nb) "
#: The walk itself, a move a step: one row holds the rooms of all sinks.
_WALK = """, u AS (SELECT site_id, x, y, CAST(round(g / (SELECT sum(abs(g)) FROM st) * 1e15) AS BIGINT) AS u FROM st WHERE g <> 0),
o AS MATERIALIZED (SELECT list({'x': x, 'y': y, 'u': u} ORDER BY site_id) FILTER (u > 0) AS src, list({'x': x, 'y': y, 'u': -u} ORDER BY site_id) FILTER (u < 0) AS snk, (SELECT sum(abs(g)) FROM st) / 1e15 AS unit FROM u),
r AS (WITH RECURSIVE w AS (SELECT 1 AS i, src[1].u AS have, list_transform(snk, lambda s: s.u) AS rooms, 0e0 AS cost, CAST(0 AS BIGINT) AS n FROM o
  UNION ALL SELECT CASE WHEN moved = have THEN i + 1 ELSE i END, CASE WHEN moved = have THEN src[i + 1].u ELSE have - moved END, list_transform(rooms, lambda v, j: CASE WHEN j = near.k THEN v - moved ELSE v END), cost + moved * unit * near.d, n + 1
  FROM (SELECT *, least(have, rooms[near.k]) AS moved FROM (SELECT w.*, o.*, list_min(list_filter(list_transform(range(1, len(snk) + 1), lambda k: {'d': (snk[k].x - src[i].x) * (snk[k].x - src[i].x) + (snk[k].y - src[i].y) * (snk[k].y - src[i].y), 'k': k}), lambda z: rooms[z.k] > 0)) AS near
    FROM w, o WHERE have IS NOT NULL) a WHERE near IS NOT NULL) b) SELECT * FROM w) """
#: The same cells of sites in another table.
_cells_of = lambda table: re.sub(r"\bsite\b", table, _CELLS)
#: Per site, weights for three frames; a cell's site_id is ten times the site's and the frame's number.
_FRAMES = ", framed AS MATERIALIZED (SELECT site_id * 10 + f AS site_id, x, y, m, w * f / 2e0 AS w FROM site, range(0, 3) g(f))" + _cells_of("framed").replace("ON i.site_id <> j.site_id", "ON i.site_id <> j.site_id AND i.site_id % 10 = j.site_id % 10")
#: The four lines of a pixel (x, y): c is cx * x + cy * y + c0.
_PIXEL = "(VALUES (-11, 1e0, 0e0, 1, 0, 1), (-12, -1e0, 0e0, -1, 0, 0), (-13, 0e0, 1e0, 0, 1, 1), (-14, 0e0, -1e0, 0, -1, 0)) s(k, a, b, cx, cy, c0)"


def _overlaps(keys: str, lines: str) -> str:
    """(keys, cov): areas of the intersections of half-planes (keys, k, a, b, c), by enumeration of their corners."""
    same = " AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f""", q AS MATERIALIZED (SELECT {keys}, k, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a * a + b * b) AS n FROM ({lines}) z) z),
ql AS MATERIALIZED (SELECT {keys}, list({{'a': a, 'b': b, 'c': c}}) AS hs FROM q GROUP BY {keys}),
qv AS MATERIALIZED (SELECT {keys}, vx, vy FROM (SELECT {own}, (p.c * q.b - q.c * p.b) / (p.a * q.b - q.a * p.b) AS vx, (p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b) AS vy
  FROM q p JOIN q ON {same} AND p.k < q.k WHERE abs(p.a * q.b - q.a * p.b) > 1e-12) z JOIN ql USING ({keys}) WHERE len(list_filter(hs, lambda o: o.a * vx + o.b * vy - o.c > 1e-9)) = 0),
qo AS (SELECT {keys}, vx, vy, coalesce(lead(vx) OVER w, first_value(vx) OVER w) AS nx, coalesce(lead(vy) OVER w, first_value(vy) OVER w) AS ny
  FROM (SELECT *, atan2(vy - avg(vy) OVER (PARTITION BY {keys}), vx - avg(vx) OVER (PARTITION BY {keys})) AS ang FROM qv) z WINDOW w AS (PARTITION BY {keys} ORDER BY ang ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
qa AS MATERIALIZED (SELECT {keys}, abs(sum(vx * ny - nx * vy)) / 2 AS cov FROM qo GROUP BY {keys}) """


_squares = lambda key, x, y, table: f"(SELECT {key}, x, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM (SELECT {key}, CAST(floor(min({x}) + 1e-9) AS INT) AS x0, CAST(ceil(max({x}) - 1e-9) AS INT) AS x1, CAST(floor(min({y}) + 1e-9) AS INT) AS y0, CAST(ceil(max({y}) - 1e-9) AS INT) AS y1 FROM {table} GROUP BY {key}) z) z)"
#: A polygon's edge as a line with the polygon on its left.
_EDGE = "e.ny - e.y AS a, e.x - e.nx AS b, (e.ny - e.y) * e.x + (e.x - e.nx) * e.y AS c"
_POLY_PIXELS = f", pp AS MATERIALIZED {_squares('poly_id', 'x', 'y', 'edge')}" + _overlaps("poly_id, x, y", f"SELECT pp.poly_id, pp.x, pp.y, e.i AS k, {_EDGE} FROM pp JOIN edge e USING (poly_id) UNION ALL SELECT poly_id, x, y, k, a, b, cx * x + cy * y + c0 FROM pp, {_PIXEL}")
_CELL_PIXELS = _CELLS + f", pp AS MATERIALIZED {_squares('site_id', 'x', 'y', 'v')}" + _overlaps("site_id, x, y", f"SELECT pp.site_id, pp.x, pp.y, h.nb AS k, h.a, h.b, h.c FROM pp JOIN h USING (site_id) JOIN (SELECT site_id, n1 AS nb FROM v UNION SELECT site_id, n2 FROM v) u ON u.site_id = h.site_id AND u.nb = h.nb UNION ALL SELECT site_id, x, y, k, a, b, cx * x + cy * y + c0 FROM pp, {_PIXEL}") + """,
im AS MATERIALIZED (SELECT site_id, sum(cov * v) AS mass, sum(cov * v * x) AS mx, sum(cov * v * y) AS my, sum(cov * v * (x * x + y * y)) AS mm FROM qa JOIN px USING (x, y) GROUP BY site_id),
ist AS (SELECT s.*, coalesce(mass / (SELECT sum(mass) FROM im), 0e0) AS mu, mx / nullif(mass, 0) AS cx, my / nullif(mass, 0) AS cy, coalesce((mm - 2 * s.x * mx - 2 * s.y * my + (s.x * s.x + s.y * s.y) * mass) / (SELECT sum(mass) FROM im), 0e0) AS sqint FROM site s LEFT JOIN im USING (site_id)) """

SQL = {
    "power_assignment_mass": with_tables("site pt", _STATS + "SELECT site_id, round(mu, 6) AS mu, round(g, 6) AS g FROM st"),
    "nearest_site": with_tables("site pt", _NEAR + "SELECT pid, a.s AS site_id, round(a.d2, 6) AS d2 FROM a"),
    "lloyd_energy": with_tables("site pt", _NEAR + "SELECT round(sum(m * a.d2), 6) AS energy, count(*) AS n FROM a"),
    "lloyd_step": with_tables("site pt", _NEAR + _STEP.format("LEFT JOIN")),
    "lloyd_step_clean": with_tables("site pt", _NEAR + _STEP.format("JOIN")),
    "coarsen_masses": with_tables("site hier", f", n AS (SELECT site_id, x, y FROM hier WHERE level = 1), a AS ({_assigned('site', 'site_id', 'n', '0e0')}) SELECT a.s AS site_id, round(sum(m), 6) AS m, count(*) AS n FROM a GROUP BY a.s"),
    "measure_normalize": "SELECT CAST(o_orderkey AS BIGINT) AS id, round(o_totalprice / (sum(o_totalprice) OVER ()), 12) AS m FROM orders",
    "measure_bbox_diameter": with_tables("pt", "SELECT round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1, round(sqrt((max(x) - min(x)) ^ 2 + (max(y) - min(y)) ^ 2), 6) AS diameter, round(2 * greatest(sqrt(min(x) ^ 2 + min(y) ^ 2), sqrt(max(x) ^ 2 + max(y) ^ 2)), 6) AS clamp_radius FROM pt"),
    "dirac_cdf": with_tables("site", "SELECT site_id, round(m, 9) AS m, round(sum(m) OVER (ORDER BY site_id), 9) AS cdf FROM site"),
    "inverse_cdf_sample": with_tables("site uni", ", c AS (SELECT *, sum(m) OVER (ORDER BY site_id) AS cdf FROM site) SELECT k, site_id, round(x, 6) AS x, round(y, 6) AS y FROM uni JOIN c ON u1 > cdf - m AND u1 <= cdf"),
    "triangle_sample": with_tables("uni", "SELECT k, round(2.25e0 + s * (17.6e0 - 2.25e0) + t * (8.4e0 - 2.25e0), 6) AS x, round(1.35e0 + s * (2.15e0 - 1.35e0) + t * (8.85e0 - 1.35e0), 6) AS y FROM (SELECT k, CASE WHEN u1 + u2 > 1 THEN 1 - u1 ELSE u1 END AS s, CASE WHEN u1 + u2 > 1 THEN 1 - u2 ELSE u2 END AS t FROM uni) z"),
    "hier_ancestor": with_tables("hier", "SELECT a.site_id, b.parent_id AS ancestor FROM hier a JOIN hier b ON b.level = 1 AND b.site_id = a.parent_id WHERE a.level = 0"),
    "hier_prolong_weights": with_tables("hier", "SELECT a.site_id, CASE WHEN b.parent_id < 4 THEN b.parent_id * 0.5e0 + 1e0 ELSE 0e0 END AS w FROM hier a JOIN hier b ON b.level = 1 AND b.site_id = a.parent_id WHERE a.level = 0"),
    "hier_wasserstein": with_tables("hier", ", q AS (SELECT 0 AS low, 1 AS high, a.m, a.x, a.y, b.x AS bx, b.y AS cy FROM hier a JOIN hier b ON a.level = 0 AND b.level = 1 AND b.site_id = a.parent_id UNION ALL SELECT 1, 2, a.m, a.x, a.y, b.x, b.y FROM hier a JOIN hier b ON a.level = 1 AND b.level = 2 AND b.site_id = a.parent_id UNION ALL SELECT 0, 2, a.m, a.x, a.y, c.x, c.y FROM hier a JOIN hier b ON a.level = 0 AND b.level = 1 AND b.site_id = a.parent_id JOIN hier c ON c.level = 2 AND c.site_id = b.parent_id) SELECT low, high, round(sqrt(sum(m * ((x - bx) ^ 2 + (y - cy) ^ 2))), 6) AS w2 FROM q GROUP BY low, high"),
    "hier_rollup_mass": with_tables("hier", "SELECT p.level, p.site_id, round(p.m, 9) AS m, round(sum(c.m), 9) AS child_m, count(*) AS n_children FROM hier p JOIN hier c ON c.level = p.level - 1 AND c.parent_id = p.site_id GROUP BY p.level, p.site_id, p.m"),
    "image_total_mass": with_tables("px", "SELECT CAST(sum(v) AS BIGINT) AS total, count(*) AS n_pixels, max(v) AS top FROM px"),
    "image_avg_gray": with_tables("px", "SELECT CAST(sum(v) AS BIGINT) AS total, CAST((max(x) + 1) * (max(y) + 1) AS BIGINT) AS area, round(CAST(sum(v) AS DOUBLE) / ((max(x) + 1) * (max(y) + 1)), 6) AS avg_gray FROM px"),
    "image_invert": with_tables("px", "SELECT x, y, 255 - v AS v FROM px"),
    "image_cdf": with_tables("px", "SELECT x, y, round(CAST(sum(v) OVER (ORDER BY y, x) AS DOUBLE) / (sum(v) OVER ()), 9) AS cdf FROM px"),
    "polygon_area_bbox": with_tables("edge", "SELECT poly_id, round(sum(x * ny - nx * y) / 2, 6) AS area, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM edge GROUP BY poly_id"),
    "uniform_moments": with_tables("edge", """SELECT poly_id, round(sum(k) / 980, 9) AS mass, round(sum((x + nx) * k) / (3 * sum(k)), 9) AS cx, round(sum((y + ny) * k) / (3 * sum(k)), 9) AS cy,
      round(sum(((x - px) * (ny - py) - (nx - px) * (y - py)) * ((x - px) * (x - px) + (x - px) * (nx - px) + (nx - px) * (nx - px) + (y - py) * (y - py) + (y - py) * (ny - py) + (ny - py) * (ny - py))) / 12 / 490, 9) AS sqint
      FROM (SELECT *, x * ny - nx * y AS k, first_value(x) OVER (PARTITION BY poly_id ORDER BY i) AS px, first_value(y) OVER (PARTITION BY poly_id ORDER BY i) AS py FROM edge) z GROUP BY poly_id"""),
    "segment_integral": with_tables("seg", "SELECT seg_id, round(l / 490, 6) AS mass, round(l * (l * l / 3 + (x1 - x0) * x0 + (y1 - y0) * y0 + x0 * x0 + y0 * y0) / 490, 6) AS sqint FROM (SELECT *, sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) AS l FROM seg) z"),
    "rect_pixel_coverage": with_tables("rect", _COVER + "SELECT rect_id, x, y, round(cov, 6) AS cov FROM c WHERE cov > 1e-9"),
    "rect_image_moments": with_tables("rect px", _COVER + "SELECT r.rect_id, round(coalesce(sum(cov * v), 0e0), 6) AS mass, round(sum(cov * v * x) / nullif(sum(cov * v), 0), 6) AS cx, round(sum(cov * v * y) / nullif(sum(cov * v), 0), 6) AS cy FROM rect r LEFT JOIN (SELECT * FROM c JOIN px USING (x, y)) z USING (rect_id) GROUP BY r.rect_id"),
    "image_sqdist_integral": with_tables("rect px", _COVER + "SELECT rect_id, round(sum(cov * ((x - 24.5e0) ^ 2 + (y - 5e0) ^ 2) * v), 6) AS integral FROM c JOIN px USING (x, y) GROUP BY rect_id"),
    "convex_pixel_coverage": with_tables("edge", "SELECT poly_id, round(sum(x * ny - nx * y) / 2, 6) AS covered FROM edge GROUP BY poly_id"),
    "polygon_sample": with_tables("poly uni", """, q AS (SELECT poly_id, vs, u1, u2, len(vs) = 3 AS three, ((vs[2].x - vs[1].x) * (vs[3].y - vs[1].y) - (vs[3].x - vs[1].x) * (vs[2].y - vs[1].y)) / 2 AS a,
        CASE WHEN len(vs) = 3 THEN 0e0 ELSE ((vs[3].x - vs[1].x) * (vs[4].y - vs[1].y) - (vs[4].x - vs[1].x) * (vs[3].y - vs[1].y)) / 2 END AS b FROM poly JOIN uni ON k = poly_id),
      r AS (SELECT *, three OR u1 < a / (a + b) AS first, CASE WHEN three THEN u1 WHEN u1 < a / (a + b) THEN u1 / (a / (a + b)) ELSE (u1 - a / (a + b)) / (1 - a / (a + b)) END AS u FROM q),
      f AS (SELECT *, CASE WHEN u + u2 > 1 THEN 1 - u ELSE u END AS s, CASE WHEN u + u2 > 1 THEN 1 - u2 ELSE u2 END AS t, CASE WHEN first THEN vs[2] ELSE vs[3] END AS p, CASE WHEN first THEN vs[3] ELSE vs[len(vs)] END AS z FROM r)
      SELECT poly_id, round(vs[1].x + s * (p.x - vs[1].x) + t * (z.x - vs[1].x), 6) AS x, round(vs[1].y + s * (p.y - vs[1].y) + t * (z.y - vs[1].y), 6) AS y, true AS inside FROM f"""),
    "displacement_interpolation": with_tables("site", _CELLS + """, d AS (SELECT s.site_id, s.m, s.x, s.y, mx / area AS cx, my / area AS cy, (SELECT max(sqrt((v.x - mx / area) ^ 2 + (v.y - my / area) ^ 2)) FROM v WHERE v.site_id = s.site_id) AS far FROM site s JOIN mo USING (site_id) WHERE area > 0),
      f AS (SELECT *, i / 10e0 AS t FROM d, range(0, 11) g(i))
      SELECT site_id, round(t, 6) AS t, round((1 - t) * x + t * cx, 6) AS x, round((1 - t) * y + t * cy, 6) AS y, round(t * far, 6) AS r,
        round(least(255e0, coalesce(255e0 * m / nullif(3.141592653589793e0 * (t * far) * (t * far) / 490, 0e0), 255e0)), 6) AS gray FROM f"""),
    "segment_raster_length": with_tables("seg", _CROSS + "SELECT seg_id, round(sum(len), 6) AS len, count(*) AS n_pixels FROM sp GROUP BY seg_id"),
    "segment_image_mass": with_tables("seg px", _CROSS + "SELECT seg_id, round(sum(len * v), 4) AS mass FROM sp JOIN px USING (x, y) GROUP BY seg_id"),
    "segment_clip": with_tables("seg", """SELECT seg_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM (SELECT seg_id,
      greatest(0e0, CASE WHEN x1 > x0 THEN (10 - x0) / (x1 - x0) WHEN x1 < x0 THEN (40 - x0) / (x1 - x0) WHEN x0 BETWEEN 10 AND 40 THEN 0e0 ELSE 2e0 END, CASE WHEN y1 > y0 THEN (2 - y0) / (y1 - y0) WHEN y1 < y0 THEN (8 - y0) / (y1 - y0) WHEN y0 BETWEEN 2 AND 8 THEN 0e0 ELSE 2e0 END) AS t0,
      least(1e0, CASE WHEN x1 > x0 THEN (40 - x0) / (x1 - x0) WHEN x1 < x0 THEN (10 - x0) / (x1 - x0) ELSE 1e0 END, CASE WHEN y1 > y0 THEN (8 - y0) / (y1 - y0) WHEN y1 < y0 THEN (2 - y0) / (y1 - y0) ELSE 1e0 END) AS t1 FROM seg) z WHERE t0 < t1"""),
    "laguerre_cell_moments": with_tables("site", _CELLS + "SELECT s.site_id, round(coalesce(area, 0e0), 6) AS area, round(mx / area, 6) AS cx, round(my / area, 6) AS cy FROM site s LEFT JOIN mo USING (site_id)"),
    "laguerre_hidden": with_tables("site", ", heavy AS MATERIALIZED (SELECT site_id, x, y, m, 40 * w AS w FROM site)" + _cells_of("heavy") + "SELECT site_id FROM heavy WHERE site_id NOT IN (SELECT site_id FROM mo WHERE area > 1e-9)"),
    "cell_morph": with_tables("site", _FRAMES + "SELECT site_id // 10 AS site_id, (site_id % 10) / 2e0 AS t, round(area, 4) AS area, round(m * ((site_id % 10) / 2e0 * 128e0 + (1 - (site_id % 10) / 2e0) * 96e0) * 490e0 / area, 4) AS gray FROM framed JOIN mo USING (site_id) WHERE area > 1e-9"),
    "displacement_arrows": with_tables("site", _CELLS + "SELECT site_id, round(x, 6) AS x, round(y, 6) AS y, round(mx / area, 6) AS tx, round(my / area, 6) AS ty FROM site JOIN mo USING (site_id) WHERE area > 0"),
    "polygon_image_mass": with_tables("edge px", _POLY_PIXELS + "SELECT poly_id, round(coalesce(sum(cov * v), 0e0), 4) AS mass, round(sum(cov * v * x) / nullif(sum(cov * v), 0), 4) AS cx, round(sum(cov * v * y) / nullif(sum(cov * v), 0), 4) AS cy FROM poly LEFT JOIN (SELECT * FROM qa JOIN px USING (x, y)) z USING (poly_id) GROUP BY poly_id"),
    "convex_clip_area": with_tables("edge rect", _overlaps("poly_id", f"SELECT poly_id, e.i AS k, {_EDGE} FROM edge e JOIN rect ON rect_id = poly_id UNION ALL SELECT rect_id, k, a, b, c FROM (SELECT rect_id, unnest([{{'k': -11, 'a': 1e0, 'b': 0e0, 'c': x1}}, {{'k': -12, 'a': -1e0, 'b': 0e0, 'c': -x0}}, {{'k': -13, 'a': 0e0, 'b': 1e0, 'c': y1}}, {{'k': -14, 'a': 0e0, 'b': -1e0, 'c': -y0}}], recursive := true) FROM rect) r") + "SELECT poly_id, round(coalesce(cov, 0e0), 6) AS area FROM rect JOIN poly ON poly_id = rect_id LEFT JOIN qa USING (poly_id)"),
    "laguerre_image_mass": with_tables("site px", _CELL_PIXELS + "SELECT site_id, round(mu, 5) AS mu, round(cx, 5) AS cx, round(cy, 5) AS cy FROM ist"),
    "lloyd_image_step": with_tables("site px", ", flat AS MATERIALIZED (SELECT * REPLACE (0e0 AS w) FROM site)" + re.sub(r"\bsite\b", "flat", _CELL_PIXELS)
        + "SELECT site_id, round(coalesce(cx, x), 5) AS x, round(coalesce(cy, y), 5) AS y, round(mu, 5) AS m, round(sqrt((coalesce(cx, x) - x) ^ 2 + (coalesce(cy, y) - y) ^ 2), 5) AS move FROM ist"),
    "objective_image": with_tables("site px", _CELL_PIXELS + "SELECT round(-(sum(sqint) - sum((mu - m) * w)), 5) AS f, round(sum(sqint), 5) AS w2_squared, count(*) FILTER (mu <> 0) AS active FROM ist"),
    "rect_touched_pixels": with_tables("rect", _COVER + "SELECT rect_id, count(*) AS n, CAST(count(*) AS DOUBLE) AS area FROM c WHERE cov > 0 GROUP BY rect_id"),
    "lloyd_energy_gradient": with_tables("site pt", _NEAR + ", e AS (SELECT a.s AS site_id, sum(m * a.d2) AS energy FROM a GROUP BY a.s) SELECT s.site_id, round(coalesce(energy, 0e0), 6) AS energy, round(coalesce(2 * (t.m * s.x - mx), 0e0), 6) AS gx, round(coalesce(2 * (t.m * s.y - my), 0e0), 6) AS gy FROM site s LEFT JOIN t USING (site_id) LEFT JOIN e USING (site_id)"),
    "weights_distance": with_tables("site", "SELECT round(sqrt(sum((d - a) * (d - a))) / count(*), 9) AS distance, count(*) AS n FROM (SELECT w - 100 * m AS d, avg(w - 100 * m) OVER () AS a FROM site) z"),
    "random_domain_points": with_tables("uni", "SELECT k, round(CASE WHEN low THEN s * 49e0 + t * 49e0 ELSE s * 49e0 END, 6) AS x, round(CASE WHEN low THEN t * 10e0 ELSE s * 10e0 + t * 10e0 END, 6) AS y FROM (SELECT k, low, CASE WHEN u + u2 > 1 THEN 1 - u ELSE u END AS s, CASE WHEN u + u2 > 1 THEN 1 - u2 ELSE u2 END AS t FROM (SELECT k, u1 <= 0.5e0 AS low, CASE WHEN u1 <= 0.5e0 THEN 2 * u1 ELSE 2 * u1 - 1 END AS u, u2 FROM uni) z) z"),
    "image_sample": with_tables("px uni", ", c AS (SELECT x, y, v, CAST(sum(v) OVER () AS DOUBLE) AS total, CAST(sum(v) OVER (ORDER BY y, x) AS DOUBLE) AS upto FROM px WHERE v > 0), g AS (SELECT k, x + (u1 * total - (upto - v)) / v AS x, y + u2 AS y FROM uni JOIN c ON u1 > (upto - v) / total AND u1 <= upto / total) SELECT k, round(x, 5) AS x, round(y, 5) AS y FROM g WHERE x > 0 AND x < 49 AND y > 0 AND y < 10"),
    "ray_clip": with_tables("seg", """SELECT seg_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM (SELECT seg_id,
      greatest(0e0, CASE WHEN x1 > x0 THEN (10 - x0) / (x1 - x0) WHEN x1 < x0 THEN (40 - x0) / (x1 - x0) WHEN x0 BETWEEN 10 AND 40 THEN 0e0 ELSE 1e9 END, CASE WHEN y1 > y0 THEN (2 - y0) / (y1 - y0) WHEN y1 < y0 THEN (8 - y0) / (y1 - y0) WHEN y0 BETWEEN 2 AND 8 THEN 0e0 ELSE 1e9 END) AS t0,
      least(CASE WHEN x1 > x0 THEN (40 - x0) / (x1 - x0) WHEN x1 < x0 THEN (10 - x0) / (x1 - x0) ELSE 1e9 END, CASE WHEN y1 > y0 THEN (8 - y0) / (y1 - y0) WHEN y1 < y0 THEN (2 - y0) / (y1 - y0) ELSE 1e9 END) AS t1 FROM seg) z WHERE t0 < t1"""),
    "laguerre_edges": with_tables("site", _CELLS + "SELECT site_id, nb AS neighbour, round(len, 6) AS len FROM ed"),
    "hessian_entries": with_tables("site", _CELLS + _HESSIAN + "SELECT i, j, round(h, 9) AS h FROM hs UNION ALL SELECT i, i, round(-sum(h), 9) FROM hs GROUP BY i"),
    "objective_uniform": with_tables("site", _CELLS + "SELECT round(-(sum(coalesce(sq, 0e0)) / 490 - sum((coalesce(area, 0e0) / 490 - m) * w)), 6) AS f, round(sum(sq) / 490, 6) AS w2_squared, count(*) FILTER (area > 0) AS active FROM site LEFT JOIN mo USING (site_id)"),
    "level_view_gray": with_tables("site", _CELLS + "SELECT site_id, round(area, 5) AS area, round(greatest(0e0, least(255e0, m * 128e0 * 490e0 / area)), 5) AS gray FROM site JOIN mo USING (site_id) WHERE area > 0"),
    "objective_value": with_tables("site pt", _STATS + "SELECT round(-(sum(sqint) - sum(g * w)), 6) AS f, round(sum(sqint), 6) AS w2_squared, count(*) FILTER (mu <> 0) AS active FROM st"),
    "gradient_norms": with_tables("site pt", _STATS + "SELECT round(sum(abs(g)), 6) AS norm_1, round(sqrt(sum(g * g)), 6) AS norm_2, round(pow(sum(pow(abs(g), 3)), 1 / 3e0), 6) AS norm_p, round(max(abs(g)), 6) AS norm_inf FROM st"),
    "misaffected_mass": with_tables("site pt", _STATS + "SELECT round(sum(abs(g)) / 2, 6) AS misaffected, round(sum(CASE WHEN g > 0 THEN g ELSE 0e0 END), 6) AS excess, round(sum(CASE WHEN g <= 0 THEN -g ELSE 0e0 END), 6) AS lack FROM st"),
    "greedy_wasserstein_bound": with_tables("site pt", _STATS + _WALK + "SELECT round(sqrt(arg_max(cost, n)), 6) AS bound, max(n) AS n_moves FROM r"),
    "trivial_error_bound": with_tables("site pt", _STATS + "SELECT round(sqrt((max(x) - min(x)) ^ 2 + (max(y) - min(y)) ^ 2), 6) AS diameter, round(sqrt(sum(abs(g)) / 2) * sqrt((max(x) - min(x)) ^ 2 + (max(y) - min(y)) ^ 2), 6) AS bound FROM st"),
}
