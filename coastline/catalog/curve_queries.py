"""Queries on geometry, features, box counting, rotation and sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.catalog import sql
from coastline.catalog.registering import register_into
from coastline.catalog.tables import event_curves, order_curves, rounded, table
from coastline.operators import boxcount, curves, features, rotation, rules, sensitivity

QUERIES, ORACLES = {}, {}


query = register_into(QUERIES, ORACLES)


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)


def quarter_params(segs: DataFrame, steps: int = 5) -> DataFrame:
    """From a quarter of the domain's smaller side down by halves."""
    box = curves.bounding_boxes(segs)
    return box.select("curve_id", "xmin", "xmax", "ymin", "ymax", (F.least("width", "height") / 4).alias("initial_delta"), F.lit(2.0).alias("delta_factor"), F.lit(steps).alias("num_steps"))


def _params(steps: int = 5) -> str:
    return f"params AS (SELECT curve_id, least(width, height) / 4 AS initial_delta, 2e0 AS delta_factor, {steps} AS num_steps FROM box WHERE least(width, height) > 0)"


_FIT = """fit AS (
  SELECT curve_id, regr_slope(ln(n_boxes), ln(1 / delta)) AS slope, regr_intercept(ln(n_boxes), ln(1 / delta)) AS intercept, regr_r2(ln(n_boxes), ln(1 / delta)) AS r2,
         regr_sxx(ln(n_boxes), ln(1 / delta)) AS sxx, regr_syy(ln(n_boxes), ln(1 / delta)) AS syy, count(*) AS n, count(DISTINCT n_boxes) AS d
  FROM counts GROUP BY curve_id)"""
_DIMENSION = """SELECT curve_id, true AS valid, CAST(NULL AS VARCHAR) AS reason, round(slope, 6) AS dimension, round(r2, 6) AS r_squared, round(sqrt(greatest(0e0, (1 - r2) * syy / sxx / (n - 2))), 6) AS std_err
FROM fit WHERE d >= 3"""


@query(_with(sql.EVENT_CURVES, sql.BOXES, _params(), sql.ladder(), sql.cells(), _FIT, recursive=True) + _DIMENSION)
def boxdim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    return rounded(boxcount.dimensions(segs, quarter_params(segs)).where("valid"))


@query(_with(sql.ORDER_CURVES, sql.BOXES, _params(4), sql.ladder(), sql.cells(), _FIT, recursive=True) + _DIMENSION)
def boxdim_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = order_curves(spark, sf_dir).withColumns({c: F.col(c) / 10000 for c in ("y1", "y2")})
    return rounded(boxcount.dimensions(segs, quarter_params(segs, 4)).where("valid"))


ORACLES["boxdim_orders"] = ORACLES["boxdim_orders"].replace("CAST(o_totalprice AS DOUBLE) AS y", "CAST(o_totalprice AS DOUBLE) / 10000 AS y")


@query(_with(sql.EVENT_CURVES, sql.BOXES, _params(), sql.ladder(), sql.cells(), recursive=True) + "SELECT curve_id, CAST(k AS INTEGER) AS k, round(delta, 9) AS delta, n_boxes FROM counts")
def boxcount_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    return rounded(boxcount.box_counts(segs, boxcount.ladder(quarter_params(segs))), 9)


_SETS = "sets(s, initial_delta, delta_factor, num_steps) AS (VALUES (0, 0.5e0, 1.8e0, 15), (1, 500e0, 1.5e0, 5), (2, 8e0, 2e0, 4), (3, 8e0, 1e0, 3))"


@query(
    _with(
        sql.EVENT_CURVES, sql.BOXES, _SETS, "params AS (SELECT curve_id, s, initial_delta, delta_factor, num_steps, least(width, height) AS small FROM box, sets)",
        sql.ladder("curve_id, s"), "last AS (SELECT curve_id, s, min(delta) FILTER (k = num_steps - 1) AS d FROM ladder GROUP BY curve_id, s)", recursive=True,
    )
    + """SELECT p.curve_id, CAST(p.s AS INTEGER) AS s, CASE WHEN d < small / 1000 THEN 'delta_too_small' WHEN initial_delta > small THEN 'initial_delta_too_large' END AS reason
FROM params p JOIN last USING (curve_id, s)"""
)
def boxdim_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([(0, 0.5, 1.8, 15), (1, 500.0, 1.5, 5), (2, 8.0, 2.0, 4), (3, 8.0, 1.0, 3)], "s int, initial_delta double, delta_factor double, num_steps int")
    return boxcount.gate(curves.bounding_boxes(event_curves(spark, sf_dir)).crossJoin(F.broadcast(sets))).select("curve_id", "s", "reason")


@query(_with(sql.EVENT_CURVES, sql.BOXES, "params AS (SELECT curve_id, 8e0 AS initial_delta, 1e0 AS delta_factor, 3 AS num_steps FROM box WHERE least(width, height) >= 8)", sql.ladder(), sql.cells(), recursive=True)
       + "SELECT curve_id, CASE WHEN count(DISTINCT n_boxes) < 3 THEN 'insufficient_variation' END AS reason FROM counts GROUP BY curve_id")
def boxdim_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    params = curves.bounding_boxes(segs).where("least(width, height) >= 8").withColumns({"initial_delta": F.lit(8.0), "delta_factor": F.lit(1.0), "num_steps": F.lit(3)})
    return boxcount.dimensions(segs, params).select("curve_id", "reason")


@query(_with(sql.EVENT_CURVES, sql.BOXES, _params(), sql.ladder(), sql.cells(), _FIT, recursive=True) + "SELECT curve_id, round(slope, 6) AS dimension, round(intercept, 6) AS intercept, round(r2, 6) AS r_squared FROM fit")
def boxdim_ungated(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    fit = boxcount.regression(boxcount.box_counts(segs, boxcount.ladder(quarter_params(segs)), gathered=True), ["curve_id"])
    return rounded(fit.select("curve_id", F.col("slope").alias("dimension"), "intercept", F.col("r2").alias("r_squared")))


@query(_with(sql.EVENT_CURVES, sql.BOXES) + "SELECT * FROM box")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.bounding_boxes(event_curves(spark, sf_dir))


@query(_with(sql.EVENT_CURVES) + "SELECT curve_id, seg_idx, x1, y1, x2, y2, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 9) AS length, round(atan2(y2 - y1, x2 - x1), 9) + 0.0 AS angle FROM segs")
def segment_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.geometry(event_curves(spark, sf_dir)).withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("length", "angle")})


@query(_with(sql.EVENT_CURVES) + "SELECT curve_id, seg_idx * 2 AS pos, x1 AS x, y1 AS y FROM segs UNION ALL SELECT curve_id, seg_idx * 2 + 1, x2, y2 FROM segs")
def segment_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.endpoints(event_curves(spark, sf_dir))


@query(_with(sql.EVENT_CURVES, sql.FEATURES) + f"SELECT curve_id, {sql.rounded('angle_std angle_range')}, direction_changes, round(direction_change_rate, 6) AS direction_change_rate FROM feat")
def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.roughness(event_curves(spark, sf_dir)))


@query(_with(sql.EVENT_CURVES, sql.FEATURES) + f"SELECT curve_id, {sql.rounded('tortuosity dimension_estimate total_length euclidean_length')} FROM feat")
def tortuosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.features(event_curves(spark, sf_dir)).select("curve_id", "tortuosity", "dimension_estimate", "total_length", "euclidean_length"))


@query(_with(sql.EVENT_CURVES, sql.FEATURES) + f"SELECT curve_id, {sql.rounded('mean_segment_length segment_length_std segment_length_cv aspect_ratio linearity_r_squared')} FROM feat")
def straightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.features(event_curves(spark, sf_dir)).select("curve_id", "mean_segment_length", "segment_length_std", "segment_length_cv", "aspect_ratio", "linearity_r_squared"))


_DOUBLES = " ".join(c for c in features.FEATURES if c not in ("n_segments", "direction_changes"))


@query(_with(sql.EVENT_CURVES, sql.FEATURES) + f"SELECT curve_id, n_segments, direction_changes, {sql.rounded(_DOUBLES)} FROM feat")
def features23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.features(event_curves(spark, sf_dir)))


@query(_with(sql.EVENT_CURVES, sql.FEATURES) + f"SELECT curve_id, {sql.CLASS} AS interface_type FROM feat")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(features.features(event_curves(spark, sf_dir))).select("curve_id", "interface_type")


_TYPED = _with(sql.EVENT_CURVES, sql.FEATURES, f"typed AS (SELECT *, {sql.CLASS} AS interface_type FROM feat)")


@query(
    _TYPED
    + """SELECT curve_id, interface_type,
  round(CASE interface_type WHEN 'straight_line' THEN mean_segment_length * 8 WHEN 'extreme_turning_fractal' THEN characteristic_length * 0.03e0 WHEN 'high_turning_fractal' THEN characteristic_length * 0.05e0
    WHEN 'koch_curve' THEN characteristic_length * 0.1e0 WHEN 'complex_fractal' THEN characteristic_length * 0.2e0 WHEN 'moderate_fractal' THEN characteristic_length * 0.2e0 ELSE characteristic_length * 0.3e0 END, 6) AS initial_delta,
  CASE interface_type WHEN 'extreme_turning_fractal' THEN 1.3e0 WHEN 'high_turning_fractal' THEN 1.4e0 WHEN 'simple_curve' THEN 1.5e0 ELSE 1.8e0 END AS delta_factor,
  CASE interface_type WHEN 'straight_line' THEN 25 WHEN 'extreme_turning_fractal' THEN 35 WHEN 'high_turning_fractal' THEN 30 WHEN 'koch_curve' THEN 30 WHEN 'simple_curve' THEN 15 ELSE 20 END AS num_steps,
  CASE WHEN interface_type = 'simple_curve' THEN 'low' WHEN interface_type IN ('complex_fractal', 'moderate_fractal') THEN 'medium' ELSE 'high' END AS confidence_level FROM typed"""
)
def heuristic_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = rules.classify(features.features(event_curves(spark, sf_dir)))
    return rounded(rules.heuristic_parameters(typed).select("curve_id", "interface_type", "initial_delta", "delta_factor", "num_steps", "confidence_level"))


@query(
    _TYPED
    + """SELECT curve_id, interface_type <> 'straight_line' AS rotation_enabled, CAST(CASE interface_type WHEN 'extreme_turning_fractal' THEN 19 WHEN 'high_turning_fractal' THEN 19 WHEN 'koch_curve' THEN 7
  WHEN 'complex_fractal' THEN 7 WHEN 'straight_line' THEN 1 ELSE 5 END AS INTEGER) AS n_angles, CASE interface_type WHEN 'straight_line' THEN 0e0 ELSE 90e0 END AS last_angle FROM typed"""
)
def rotation_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = rules.rotation_policy(rules.classify(features.features(event_curves(spark, sf_dir))))
    return typed.select("curve_id", "rotation_enabled", F.size("rotation_angles").alias("n_angles"), F.element_at("rotation_angles", -1).alias("last_angle"))


_ROT = "((x{k} - cx) * cos(radians(30e0)) - (y{k} - cy) * sin(radians(30e0)) + cx) AS rx{k}, ((x{k} - cx) * sin(radians(30e0)) + (y{k} - cy) * cos(radians(30e0)) + cy) AS ry{k}"
_TURNED = _ROT.format(k=1) + ", " + _ROT.format(k=2)
_R4 = "SELECT curve_id, seg_idx, round(rx1, 6) AS x1, round(ry1, 6) AS y1, round(rx2, 6) AS x2, round(ry2, 6) AS y2 FROM r"


@query(_with(sql.EVENT_CURVES, sql.BOXES, "c AS (SELECT curve_id, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM box)", f"r AS (SELECT curve_id, seg_idx, {_TURNED} FROM segs JOIN c USING (curve_id))") + _R4)
def rotate_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    return rounded(curves.rotated(segs, 30.0, curves.centres(curves.bounding_boxes(segs))))


@query(_with(sql.EVENT_CURVES, f"r AS (SELECT curve_id, seg_idx, {_TURNED} FROM (SELECT *, 0e0 AS cx, 0e0 AS cy FROM segs))") + _R4)
def rotate_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.rotated(event_curves(spark, sf_dir), 30.0))


_EXPANDED = """grown AS (
  SELECT curve_id, (xmin + xmax) / 2 - width * 1.4142135623730951 / 2 AS xmin, (xmin + xmax) / 2 + width * 1.4142135623730951 / 2 AS xmax,
         (ymin + ymax) / 2 - height * 1.4142135623730951 / 2 AS ymin, (ymin + ymax) / 2 + height * 1.4142135623730951 / 2 AS ymax FROM box)"""


@query(_with(sql.EVENT_CURVES, sql.BOXES, _EXPANDED) + f"SELECT curve_id, {sql.rounded('xmin xmax ymin ymax')}, round(xmax - xmin, 6) AS width, round(ymax - ymin, 6) AS height FROM grown")
def expanded_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.expanded(curves.bounding_boxes(event_curves(spark, sf_dir))))


@query(
    _with(sql.EVENT_CURVES, sql.BOXES)
    + """SELECT curve_id, CASE WHEN height < 0.01 THEN ymin - 0.1 ELSE ymin END AS ymin, CASE WHEN height < 0.01 THEN ymax + 0.1 ELSE ymax END AS ymax,
  round(xmin - greatest(width * 0.1, 0.5), 6) AS roomy_xmin, round(ymax + greatest(height * 0.1, 0.5), 6) AS roomy_ymax FROM box"""
)
def domain_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = curves.bounding_boxes(event_curves(spark, sf_dir))
    more = curves.roomy(box).select("curve_id", F.round("xmin", 6).alias("roomy_xmin"), F.round("ymax", 6).alias("roomy_ymax"))
    return curves.padded(box).select("curve_id", "ymin", "ymax").join(more, "curve_id")


#: Prices in tens of thousands, so that a curve is about as high as it is wide.
_ROTATED_POINTS = sql.ORDER_POINTS.replace("CAST(o_totalprice AS DOUBLE)", "CAST(o_totalprice AS DOUBLE) / 10000")
_ROTATED = f"""angles(angle_idx, rotation) AS (VALUES {", ".join(f"({i}, {a:.1f}e0)" for i, a in enumerate(rotation.ANGLES))}),
plain AS (SELECT * FROM segs),
c AS (SELECT curve_id, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM box0),
spun AS (
  SELECT curve_id, angle_idx, rotation, seg_idx,
    (x1 - cx) * cos(radians(rotation)) - (y1 - cy) * sin(radians(rotation)) + cx AS x1, (x1 - cx) * sin(radians(rotation)) + (y1 - cy) * cos(radians(rotation)) + cy AS y1,
    (x2 - cx) * cos(radians(rotation)) - (y2 - cy) * sin(radians(rotation)) + cx AS x2, (x2 - cx) * sin(radians(rotation)) + (y2 - cy) * cos(radians(rotation)) + cy AS y2
  FROM plain JOIN c USING (curve_id) CROSS JOIN angles)"""


def _rotation_sql(tail: str) -> str:
    base = _with(
        _ROTATED_POINTS, sql.SEGMENTS, sql.BOXES.replace("box AS", "box0 AS"), _ROTATED,
        "box AS (SELECT curve_id, angle_idx, rotation, xmin, xmax, ymin, ymax FROM (SELECT curve_id, (xmin + xmax) / 2 - width * 1.4142135623730951 / 2 AS xmin, (xmin + xmax) / 2 + width * 1.4142135623730951 / 2 AS xmax, "
        "(ymin + ymax) / 2 - height * 1.4142135623730951 / 2 AS ymin, (ymin + ymax) / 2 + height * 1.4142135623730951 / 2 AS ymax FROM box0) CROSS JOIN angles)",
        "params AS (SELECT curve_id, angle_idx, rotation, greatest(width, height) / 5 AS initial_delta, 1.5e0 AS delta_factor, 8 AS num_steps FROM box0 CROSS JOIN angles WHERE greatest(width, height) > 0)",
        sql.ladder("curve_id, angle_idx, rotation"), sql.cells("curve_id, angle_idx, rotation").replace("segs s", "spun s"), recursive=True,
    )
    return base + ",\n" + tail


_LEAST = "best AS (SELECT curve_id, k, delta, min(n_boxes) AS n_boxes, max(n_boxes) AS max_boxes FROM counts GROUP BY curve_id, k, delta)"


def _price_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_curves(spark, sf_dir).withColumns({c: F.col(c) / 10000 for c in ("y1", "y2")})


@query(_rotation_sql(_LEAST) + "SELECT curve_id, CAST(k AS INTEGER) AS k, round(delta, 6) AS delta, n_boxes, max_boxes FROM best")
def rotation_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _price_curves(spark, sf_dir)
    best = rotation.least_counts(rotation.counts_by_angle(segs, rotation.default_scales(segs)))
    return rounded(best.select("curve_id", "k", "delta", "n_boxes", "max_boxes"))


@query(_rotation_sql(_LEAST) + "SELECT curve_id, round(regr_slope(ln(n_boxes), ln(1 / delta)), 6) AS dimension, round(regr_r2(ln(n_boxes), ln(1 / delta)), 6) AS r_squared, CAST(count(*) AS BIGINT) AS n_scales FROM best GROUP BY curve_id HAVING count(*) >= 3")
def rotation_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rotation.rotation_dimension(_price_curves(spark, sf_dir)))


@query(
    _rotation_sql(_LEAST + ",\nplain0 AS (SELECT curve_id, regr_slope(ln(n_boxes), ln(1 / delta)) AS s FROM counts WHERE rotation = 0 GROUP BY curve_id),\nfew AS (SELECT curve_id, regr_slope(ln(n_boxes), ln(1 / delta)) AS r FROM best GROUP BY curve_id)")
    + "SELECT curve_id, round(s, 6) AS standard_dimension, round(r, 6) AS rotation_dimension, round(r - s, 6) + 0.0 AS change FROM plain0 JOIN few USING (curve_id)"
)
def rotation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rotation.compare(_price_curves(spark, sf_dir)))


@query(
    _rotation_sql("per AS (SELECT curve_id, angle_idx, rotation, regr_slope(ln(n_boxes), ln(1 / delta)) AS s FROM counts GROUP BY curve_id, angle_idx, rotation)")
    + "SELECT curve_id, CAST(count(*) AS BIGINT) AS n_angles, round(min(s), 6) AS min_dimension, round(max(s), 6) AS max_dimension, round(avg(s), 6) AS mean_dimension, round(stddev_pop(s), 6) AS std_dimension, arg_min(rotation, s) AS min_angle FROM per GROUP BY curve_id"
)
def rotation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _price_curves(spark, sf_dir)
    return rounded(rotation.by_angle(segs, rotation.default_scales(segs)))


_OFFSETS = ", ".join(f"({i}, {a}e0, {b}e0)" for i, (a, b) in enumerate(sensitivity.OFFSETS))


def _offset_sql(tail: str) -> str:
    """The grid's corner depends on the scale: the box of (curve, offset, scale)."""
    cells = sql.cells("curve_id, offset_idx, kk").replace("JOIN segs s ON s.curve_id = g.curve_id AND s.offset_idx = g.offset_idx AND s.kk = g.kk", "JOIN segs s ON s.curve_id = g.curve_id")
    return (
        _with(
            sql.EVENT_POINTS, sql.SEGMENTS, sql.BOXES.replace("box AS", "box0 AS"), f"offsets(offset_idx, ox, oy) AS (VALUES {_OFFSETS})", _params(3).replace("FROM box", "FROM box0"), sql.ladder().replace("ladder AS", "ladder0 AS").replace("FROM ladder ", "FROM ladder0 "),
            "ladder AS (SELECT curve_id, offset_idx, k AS kk, k, delta FROM ladder0 CROSS JOIN offsets)",
            "box AS (SELECT l.curve_id, offset_idx, k AS kk, xmin - ox * delta AS xmin, xmax, ymin - oy * delta AS ymin, ymax FROM ladder0 l JOIN box0 USING (curve_id) CROSS JOIN offsets)",
            cells, recursive=True,
        )
        + tail
    )


@query(
    _offset_sql(
        """, s AS (SELECT curve_id, k, min(n_boxes) AS min_boxes, max(n_boxes) AS max_boxes, avg(n_boxes) AS m, stddev_pop(n_boxes) AS sd FROM counts GROUP BY curve_id, k)
SELECT curve_id, CAST(k AS INTEGER) AS k, min_boxes, max_boxes, round(m, 6) AS mean_boxes, round(sd, 6) AS std_boxes, round((max_boxes - min_boxes) / m * 100, 6) AS range_pct, round(sd / m * 100, 6) AS cv_pct,
  CASE WHEN (max_boxes - min_boxes) / m * 100 > 20 THEN 'high' WHEN (max_boxes - min_boxes) / m * 100 > 10 THEN 'moderate' WHEN (max_boxes - min_boxes) / m * 100 > 5 THEN 'low' ELSE 'minimal' END AS sensitivity FROM s"""
    )
)
def grid_offset_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    return rounded(sensitivity.spread(sensitivity.counts_by_offset(segs, boxcount.ladder(quarter_params(segs, 3)))))


@query(
    _offset_sql(
        """, s AS (SELECT curve_id, k, max(n_boxes) FILTER (offset_idx = 0) AS plain, max(n_boxes) FILTER (offset_idx = 6) AS shifted FROM counts GROUP BY curve_id, k)
SELECT curve_id, CAST(k AS INTEGER) AS k, plain, shifted, round(abs(shifted - plain) / plain * 100, 6) AS change_pct FROM s"""
    )
)
def grid_half_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    return rounded(sensitivity.half_shift(sensitivity.counts_by_offset(segs, boxcount.ladder(quarter_params(segs, 3)))))


_SLOPES = "slopes AS (SELECT curve_id, k, (ln(n_boxes) - lag(ln(n_boxes)) OVER w) / (ln(1 / delta) - lag(ln(1 / delta)) OVER w) AS slope FROM counts WINDOW w AS (PARTITION BY curve_id ORDER BY k))"


@query(_with(sql.EVENT_CURVES, sql.BOXES, _params(), sql.ladder(), sql.cells(), _SLOPES, recursive=True) + "SELECT curve_id, CAST(k AS INTEGER) AS k, round(slope, 6) + 0.0 AS slope FROM slopes WHERE slope IS NOT NULL")
def local_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    return rounded(boxcount.local_slopes(boxcount.box_counts(segs, boxcount.ladder(quarter_params(segs)), gathered=True)))


@query(
    _with(sql.EVENT_CURVES, sql.BOXES, _params(), sql.ladder(), sql.cells(), _SLOPES, recursive=True)
    + "SELECT curve_id, CAST(count(*) AS BIGINT) AS n_slopes, round(avg(slope), 6) AS mean_slope, round(stddev_pop(slope), 6) AS std_slope, round(stddev_pop(slope) / avg(slope), 6) AS cv_slope FROM slopes WHERE slope IS NOT NULL GROUP BY curve_id"
)
def slope_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    return rounded(boxcount.slope_consistency(boxcount.box_counts(segs, boxcount.ladder(quarter_params(segs)), gathered=True)))


@query(
    _with(sql.EVENT_CURVES)
    + """, t AS (SELECT *, least(abs(a - lag(a) OVER w), 6.283185307179586 - abs(a - lag(a) OVER w)) AS turn FROM (SELECT *, atan2(y2 - y1, x2 - x1) AS a, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM segs)
  WINDOW w AS (PARTITION BY curve_id ORDER BY seg_idx))
SELECT curve_id, round(avg(len), 6) AS mean_length, round(stddev_pop(len), 6) AS std_length, round(sum(len), 6) AS total_length, CAST(count(*) FILTER (turn > 0.7853981633974483) AS BIGINT) AS n_turns, CAST(count(*) AS BIGINT) AS n_segments,
  round(max(greatest(x1, x2)) - min(least(x1, x2)), 6) AS extent, round(CASE WHEN count(*) > 1 THEN count(*) FILTER (turn > 0.7853981633974483) / CAST(count(*) - 1 AS DOUBLE) ELSE 0e0 END, 6) AS turn_rate, round(sum(len) / 4, 6) AS length_ratio
FROM t GROUP BY curve_id"""
)
def turning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.turning(event_curves(spark, sf_dir), 4))
