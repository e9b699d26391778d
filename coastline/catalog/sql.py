"""Pieces of SQL that several of the catalogue's queries share."""

from __future__ import annotations

EVENT_POINTS = """pts AS (
  SELECT CAST(user_id AS VARCHAR) AS curve_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos, CAST(value AS DOUBLE) AS y
  FROM events)"""

ORDER_POINTS = """pts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS curve_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS pos, CAST(o_totalprice AS DOUBLE) AS y
  FROM orders)"""

SEGMENTS = """segs AS (
  SELECT * FROM (
    SELECT curve_id, CAST(pos - 1 AS BIGINT) AS seg_idx, CAST(pos AS DOUBLE) AS x1, y AS y1, CAST(lead(pos) OVER w AS DOUBLE) AS x2, lead(y) OVER w AS y2
    FROM pts WINDOW w AS (PARTITION BY curve_id ORDER BY pos)) WHERE x2 IS NOT NULL)"""

EVENT_CURVES = f"{EVENT_POINTS},\n{SEGMENTS}"
ORDER_CURVES = f"{ORDER_POINTS},\n{SEGMENTS}"

BOXES = """box AS (
  SELECT curve_id, min(least(x1, x2)) AS xmin, max(greatest(x1, x2)) AS xmax, min(least(y1, y2)) AS ymin, max(greatest(y1, y2)) AS ymax,
         max(greatest(x1, x2)) - min(least(x1, x2)) AS width, max(greatest(y1, y2)) - min(least(y1, y2)) AS height
  FROM segs GROUP BY curve_id)"""


def ladder(keys: str = "curve_id", table: str = "params") -> str:
    """Scales of each parameter set by repeated division: RECURSIVE ladder(keys, k, delta)."""
    return f"""ladder AS (
  SELECT {keys}, 0 AS k, initial_delta AS delta, delta_factor, num_steps FROM {table}
  UNION ALL
  SELECT {keys}, k + 1, delta / delta_factor, delta_factor, num_steps FROM ladder WHERE k + 1 < num_steps)"""


def meets() -> str:
    """Segment s meets the closed cell (i, j) of the grid from (xmin, ymin)."""
    bx0, bx1, by0, by1 = "(xmin + i * delta)", "(xmin + (i + 1) * delta)", "(ymin + j * delta)", "(ymin + (j + 1) * delta)"
    edges = []
    for a, b, lo, hi, cuts in (("x", "y", by0, by1, (bx0, bx1)), ("y", "x", bx0, bx1, (by0, by1))):
        for at in cuts:
            t = f"(({at} - {a}1) / ({a}2 - {a}1))"
            edges.append(f"CASE WHEN abs({a}2 - {a}1) > 1e-10 THEN {t} BETWEEN 0 AND 1 AND {b}1 + {t} * ({b}2 - {b}1) BETWEEN {lo} AND {hi} ELSE false END")
    inside = [f"(x{k} BETWEEN {bx0} AND {bx1} AND y{k} BETWEEN {by0} AND {by1})" for k in (1, 2)]
    apart = f"(x1 < {bx0} AND x2 < {bx0}) OR (x1 > {bx1} AND x2 > {bx1}) OR (y1 < {by0} AND y2 < {by0}) OR (y1 > {by1} AND y2 > {by1})"
    return f"NOT ({apart}) AND ({' OR '.join(inside + edges)})"


def cells(keys: str = "curve_id") -> str:
    """Distinct cells by testing every segment against the cells around it, one more on every side than it can meet."""
    on = " AND ".join(f"s.{k} = g.{k}" for k in keys.split(", "))
    names = ", ".join(f"g.{k}" for k in keys.split(", "))
    column = "CAST(least(nx - 1, greatest(0, floor(({x} - xmin) / delta) {d})) AS BIGINT)"
    first, last = column.format(x="least(x1, x2)", d="- 1"), column.format(x="greatest(x1, x2)", d="+ 1")
    at = "CASE WHEN abs(x2 - x1) > 1e-10 THEN y1 + ({x} - x1) / (x2 - x1) * (y2 - y1) ELSE {y} END"
    ya, yb = at.format(x="greatest(least(x1, x2), xmin + i * delta)", y="y1"), at.format(x="least(greatest(x1, x2), xmin + (i + 1) * delta)", y="y2")
    return f"""grid AS (
  SELECT {names.replace('g.', 'l.')}, l.k, l.delta, xmin, ymin, CAST(ceil((xmax - xmin) / delta) AS BIGINT) AS nx, CAST(ceil((ymax - ymin) / delta) AS BIGINT) AS ny
  FROM ladder l JOIN box USING ({keys})),
pairs AS MATERIALIZED (SELECT {names}, g.k, g.delta, g.xmin, g.ymin, g.ny, x1, y1, x2, y2, {first} AS i0, {last} AS i1 FROM grid g JOIN segs s ON {on}),
cols AS MATERIALIZED (SELECT *, unnest(range(i0, i1 + 1)) AS i FROM pairs),
near AS MATERIALIZED (
  SELECT *, {ya} AS ya, {yb} AS yb FROM cols
  WHERE NOT ((x1 < xmin + i * delta AND x2 < xmin + i * delta) OR (x1 > xmin + (i + 1) * delta AND x2 > xmin + (i + 1) * delta))),
tall AS MATERIALIZED (SELECT *, unnest(range(CAST(greatest(0, floor((least(ya, yb) - ymin) / delta) - 1) AS BIGINT), CAST(least(ny - 1, floor((greatest(ya, yb) - ymin) / delta) + 1) AS BIGINT) + 1)) AS j FROM near),
cells AS (SELECT DISTINCT {keys}, k, delta, i, j FROM tall WHERE {meets()}),
counts AS MATERIALIZED (SELECT {keys}, k, delta, CAST(count(*) AS BIGINT) AS n_boxes FROM cells GROUP BY {keys}, k, delta)"""


FEATURES = """turned AS (
  SELECT *, least(abs(angle - lag(angle) OVER w), 6.283185307179586 - abs(angle - lag(angle) OVER w)) AS turn
  FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, atan2(y2 - y1, x2 - x1) AS angle FROM segs)
  WINDOW w AS (PARTITION BY curve_id ORDER BY seg_idx)),
lin AS (
  SELECT curve_id, CASE WHEN min(x) = max(x) THEN 1e0 WHEN min(y) = max(y) THEN 0e0 ELSE regr_r2(y, x) END AS linearity_r_squared
  FROM (SELECT curve_id, x1 AS x, y1 AS y FROM segs UNION ALL SELECT curve_id, x2, y2 FROM segs) GROUP BY curve_id),
agg AS (
  SELECT curve_id, CAST(count(*) AS BIGINT) AS n_segments, max(greatest(x1, x2)) - min(least(x1, x2)) AS bbox_width, max(greatest(y1, y2)) - min(least(y1, y2)) AS bbox_height,
         min(len) AS min_segment_length, max(len) AS max_segment_length, avg(len) AS mean_segment_length, stddev_pop(len) AS segment_length_std, sum(len) AS total_length,
         stddev_pop(angle) AS angle_std, max(angle) - min(angle) AS angle_range, CAST(count(*) FILTER (turn > 0.5235987755982988) AS BIGINT) AS direction_changes,
         min_by(x1, seg_idx) AS fx, min_by(y1, seg_idx) AS fy, max_by(x2, seg_idx) AS lx, max_by(y2, seg_idx) AS ly
  FROM turned GROUP BY curve_id),
gap AS (SELECT *, sqrt((lx - fx) * (lx - fx) + (ly - fy) * (ly - fy)) AS g FROM agg),
tort AS (SELECT *, CASE WHEN g < 1e-6 THEN bbox_width ELSE g END AS euclidean_length FROM gap),
feat AS (
  SELECT curve_id, n_segments, bbox_width, bbox_height, bbox_width * bbox_height AS bbox_area, sqrt(bbox_width * bbox_height) AS characteristic_length, min_segment_length, max_segment_length,
         mean_segment_length, segment_length_std, CASE WHEN mean_segment_length > 0 THEN segment_length_std / mean_segment_length ELSE 0e0 END AS segment_length_cv, angle_std, angle_range,
         direction_changes, direction_changes / CAST(n_segments AS DOUBLE) AS direction_change_rate, total_length / greatest(euclidean_length, 1e-6) AS tortuosity,
         1 + least(ln(total_length / greatest(euclidean_length, 1e-6)) / ln(2e0), 1e0) AS dimension_estimate, total_length, euclidean_length, bbox_height / greatest(bbox_width, 1e-10) AS aspect_ratio,
         linearity_r_squared, direction_changes / CAST(n_segments AS DOUBLE) * angle_std AS complexity_score, max_segment_length / (min_segment_length + 1e-10) AS scale_ratio,
         n_segments / (bbox_width * bbox_height + 1e-10) AS density
  FROM tort JOIN lin USING (curve_id))"""

CLASS = """CASE WHEN segment_length_cv < 0.001 AND direction_change_rate = 0 AND angle_std < 0.001 THEN 'straight_line'
  WHEN linearity_r_squared > 0.99 AND direction_change_rate < 0.1 THEN 'straight_line'
  WHEN direction_change_rate > 0.85 AND tortuosity > 3 AND complexity_score > 1.5 THEN 'extreme_turning_fractal'
  WHEN direction_change_rate > 0.7 AND tortuosity > 3 THEN 'high_turning_fractal'
  WHEN direction_change_rate > 0.5 AND tortuosity > 1.2 THEN 'koch_curve'
  WHEN complexity_score > 0.3 THEN 'complex_fractal' WHEN tortuosity > 1.1 THEN 'moderate_fractal' ELSE 'simple_curve' END"""


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())
