"""Queries on whole studies: optimised parameters, runs over frames, libraries of curves, sweeps, and the sources behind them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.catalog.feedback_queries import _LOG, _METHODS, _methods, log
from coastline.catalog import sql
from coastline.catalog.generator_queries import _TARGET
from coastline.catalog.registering import register_into
from coastline.catalog.tables import rounded, table
from coastline.operators import consensus, contour, convergence, curves, generators, rules
from coastline.plans import studies
from coastline.sources import logs, segments

QUERIES, ORACLES = {}, {}
query = register_into(QUERIES, ORACLES)


@query(
    f"""WITH {_METHODS}, a AS (SELECT curve_id, sum(confidence) AS w, sum(confidence * initial_delta) AS d, sum(confidence * delta_factor) AS f, sum(confidence * num_steps) AS k FROM m WHERE confidence > 0 AND method <> 'other' GROUP BY curve_id)
SELECT i.curve_id, round(coalesce(d / w, 0.02e0), 9) AS initial_delta, round(coalesce(f / w, 1.5e0), 9) AS delta_factor, CAST(coalesce(floor(k / w), 15) AS INTEGER) AS num_steps, round(coalesce(w / 4, 0e0), 9) AS confidence
FROM (SELECT DISTINCT curve_id FROM m) i LEFT JOIN a USING (curve_id)"""
)
def consensus_truncating(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _methods(spark, sf_dir)
    scales = m.select("curve_id").distinct().withColumn("domain_scale", F.lit(2.0))
    return rounded(consensus.truncating(m.where("method != 'other'"), scales), 9)


@query(
    """WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS curve_id, o_totalprice / 99991 AS d, 1.5e0 AS f, 10.7e0 AS k, o_custkey / 10e0 AS w, o_custkey / 20e0 AS v FROM orders)
SELECT curve_id, 0 AS combo_idx, 'suggested' AS name, round(d, 6) AS initial_delta, f AS delta_factor, 10 AS num_steps FROM p UNION ALL SELECT curve_id, 1, 'domain_scaled', round(w * 0.05e0, 6), f, 10 FROM p
UNION ALL SELECT curve_id, 2, 'interface_scaled', round(v * 0.2e0, 6), f, 10 FROM p UNION ALL SELECT curve_id, 3, 'conservative', 0.01e0, 1.5e0, 20 FROM p"""
)
def scale_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) as curve_id", "o_totalprice / 99991 as initial_delta", "1.5D as delta_factor", "10.7D as num_steps", "o_custkey / 10D as domain_width", "o_custkey / 20D as interface_width")
    return rounded(consensus.scale_candidates(p))


_LEVELS = f"WITH {_LOG}, lv AS (SELECT interface_type AS fractal, CAST(round(log2(n_segments) / 2) AS INTEGER) AS level, avg(error_pct) AS error_pct, avg(n_segments) / 1000 AS seconds FROM log GROUP BY 1, 2)"


@query(
    _LEVELS
    + """, g AS (SELECT *, lag(error_pct, 2) OVER w - error_pct AS gain, seconds / lag(seconds) OVER w AS ratio FROM lv WHERE error_pct IS NOT NULL WINDOW w AS (PARTITION BY fractal ORDER BY level)),
r AS (SELECT fractal, CAST(count(*) AS BIGINT) AS n_levels, arg_min(level, error_pct) AS best_level, min(error_pct) AS best_error, arg_max(gain, level) AS recent_gain, arg_max(ratio, level) AS time_ratio FROM g GROUP BY fractal)
SELECT fractal, n_levels, best_level, round(best_error, 6) AS best_error, round(recent_gain, 6) + 0.0 AS recent_gain, round(time_ratio, 6) AS time_ratio, CASE WHEN recent_gain > 0 THEN 'improvement' WHEN recent_gain IS NOT NULL THEN 'plateau' END AS trend FROM r"""
)
def convergence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir).withColumn("e", F.when(F.col("dimension_result").isNotNull() & ~F.isnan("dimension_result"), F.abs(F.col("dimension_result") - F.col("theoretical_dimension")) / F.col("theoretical_dimension") * 100))
    lv = df.groupBy(F.col("interface_type").alias("fractal"), F.round(F.log2("features.n_segments") / 2).cast("int").alias("level")).agg(F.avg("e").alias("error_pct"), (F.avg("features.n_segments") / 1000).alias("seconds"))
    return rounded(convergence.report(lv))


_SIZES = "lv AS (SELECT f AS fractal, unnest(range(a, b + 1)) AS level, f AS g FROM (VALUES ('koch', 1, 7), ('dragon', 3, 12), ('hilbert', 2, 8), ('minkowski', 1, 6), ('sierpinski', 3, 8)) t(f, a, b)), sz AS (SELECT fractal, CAST(level AS INTEGER) AS level, CAST(CASE fractal WHEN 'hilbert' THEN pow(4, level) - 1 WHEN 'minkowski' THEN pow(8, level) WHEN 'sierpinski' THEN pow(3, level + 1) ELSE pow(4, level) END AS BIGINT) AS n_segments FROM lv)"
_BUDGET = ", ".join(f"('{a}', {d})" for a, _, _, d in generators.REGISTRY)


@query(f"WITH {_SIZES} SELECT fractal, level, n_segments FROM sz JOIN (VALUES {_BUDGET}) b(fractal, most) USING (fractal) QUALIFY max(CASE WHEN n_segments > most THEN 1 ELSE 0 END) OVER (PARTITION BY fractal ORDER BY level) = 0")
def level_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.within_budget(studies.levels(spark), generators.registry(spark))


@query()
def fractal_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and classes of the library's curves, each within its budget of segments."""
    return rounded(studies.library(spark).drop("curve_id"))


@query()
def rapid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeatable sample of 60 combinations of the sweep's 1,200."""
    return rounded(studies.sweep(spark))


@query()
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 1,200 combinations: how many succeed by curve, and the least error."""
    s = studies.sweep(spark, sample=None)
    return rounded(s.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.count("error_pct").alias("n_valid"), F.count_if("success").alias("successes"), F.min("error_pct").alias("best_error")))


@query()
def optimise_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.optimise(generators.koch(spark, 3), _TARGET)[0], 9)


@query()
def optimise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, scored = studies.optimise(generators.koch(spark, 3), _TARGET)
    lines = studies.report(best, scored, _TARGET, "koch_L3")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


#: A frame for each day; nodes are parts of three hours by bands of users, with the mean value of the events in them.
_BINS = """f AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS time, CAST(floor(hour(ts) / 3) AS INTEGER) AS ix, CAST(user_id % 6 AS INTEGER) AS iy, avg(value) AS v
  FROM events WHERE value IS NOT NULL GROUP BY ALL)"""
_LEVEL = 45.0


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double")
    return contour.binned(e.select(day.alias("time"), F.floor(F.hour("ts") / 3).cast("int").alias("ix"), (F.col("user_id") % 6).cast("int").alias("iy"), F.col("value").cast("double").alias("value")))


def _crossing(p: str, q: str) -> str:
    t = f"(({_LEVEL}e0 - {p}v) / ({q}v - {p}v))"
    return f"CASE WHEN ({p}v < {_LEVEL}e0) <> ({q}v < {_LEVEL}e0) THEN [{p}x + {t} * ({q}x - {p}x), {p}y + {t} * ({q}y - {p}y)] END"


_CORNERS = {"a": "ix AS {n}x, iy AS {n}y, va AS {n}v", "b": "ix + 1 AS {n}x, iy AS {n}y, vb AS {n}v", "c": "ix + 1 AS {n}x, iy + 1 AS {n}y, vc AS {n}v", "d": "ix AS {n}x, iy + 1 AS {n}y, vd AS {n}v"}
_CONTOURS = f"""WITH {_BINS},
c AS (
  SELECT a.time, a.ix, a.iy, a.v AS va, b.v AS vb, c.v AS vc, d.v AS vd FROM f a JOIN f b ON b.time = a.time AND b.ix = a.ix + 1 AND b.iy = a.iy
  JOIN f c ON c.time = a.time AND c.ix = a.ix + 1 AND c.iy = a.iy + 1 JOIN f d ON d.time = a.time AND d.ix = a.ix AND d.iy = a.iy + 1),
t AS ({" UNION ALL ".join(f"SELECT time, {_CORNERS[p].format(n='p')}, {_CORNERS[q].format(n='q')}, ix + 0.5e0 AS mx, iy + 0.5e0 AS my, (va + vb + vc + vd) / 4 AS mv FROM c" for p, q in ("ab", "bc", "cd", "ad"))}),
e AS (SELECT time, list_filter([{_crossing('p', 'q')}, {_crossing('q', 'm')}, {_crossing('p', 'm')}], lambda x: x IS NOT NULL) AS s FROM t),
l AS (SELECT time, sqrt(pow(s[1][1] - s[2][1], 2) + pow(s[1][2] - s[2][2], 2)) AS l FROM e WHERE len(s) = 2)"""


@query(_CONTOURS + " SELECT time, CAST(count(l) AS BIGINT) AS n_segments, round(coalesce(sum(l), 0e0), 6) AS length FROM (SELECT DISTINCT time FROM f) LEFT JOIN l USING (time) GROUP BY time")
def contour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of the days' fields of events; days without one keep a row."""
    return rounded(contour.by_frame(_field(spark, sf_dir), _LEVEL))


@query()
def temporal_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours, carried parameters and dimensions of the days of events."""
    return rounded(studies.evolution(_field(spark, sf_dir), _LEVEL, applied=False), 9)


@query()
def temporal_evolution_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.run_json(studies.evolution(_field(spark, sf_dir), _LEVEL, applied=False), time_step=1.0)


@query(
    """SELECT 'best' AS name, interface, CASE WHEN p < 0.001e0 THEN '***' WHEN p < 0.01e0 THEN '**' WHEN p < 0.05e0 THEN '*' ELSE '' END AS stars, CASE WHEN e < 2 THEN 'excellent' WHEN e < 5 THEN 'good' WHEN e < 10 THEN 'fair' ELSE 'poor' END AS grade
FROM (SELECT o_orderkey AS interface, (o_orderkey % 100) / 1000e0 AS p, (o_orderkey % 37) / 3e0 AS e FROM orders)"""
)
def significance_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey as interface", "(o_orderkey % 100) / 1000D as p", "(o_orderkey % 37) / 3D as e")
    return df.select(F.lit("best").alias("name"), "interface", rules.significance(F.col("p")).alias("stars"), rules.error_grade(F.col("e")).alias("grade"))


@query(
    f"""WITH pts AS (SELECT CAST(c_nationkey AS VARCHAR) AS curve_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS pos, CAST(c_acctbal AS DOUBLE) AS y FROM customer), {sql.SEGMENTS}
SELECT curve_id, seg_idx, x1, round(y1, 6) + 0.0 AS y1, x2, round(y2, 6) + 0.0 AS y2 FROM segs"""
)
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves of nations' balances written as text files and read again."""
    at = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    segments.write(curves.segments_from_points(curves.numbered_points(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], "c_acctbal")), at, "balances", 1.0)
    return rounded(segments.read(spark, f"{at}/curve_id=*/*.txt", name=r"curve_id=([^/]+)/"))


@query(f"WITH {_LOG} SELECT interface_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (success) AS BIGINT) AS successes FROM log GROUP BY interface_type")
def feedback_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as JSON lines in two parts and read again."""
    at = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df = log(spark, sf_dir)
    odd = F.col("record_id") % 2 == 1
    logs.append_feedback(df.where(odd).drop("record_id"), at)
    logs.append_feedback(df.where(~odd).drop("record_id"), at)
    return logs.read_feedback(spark, at).groupBy("interface_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("successes"))


def _scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or os.path.join(tempfile.gettempdir(), "coastline-checkpoints")
