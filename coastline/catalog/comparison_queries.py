"""Queries that hold one way of measuring against another, and a signal's whole self-similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.catalog import curve_queries, signal_queries, spectrum_queries
from coastline.catalog.feedback_queries import _L, log
from coastline.catalog.registering import register_into
from coastline.catalog.study_queries import _scratch
from coastline.catalog.tables import rounded, table
from coastline.operators import comparison, feedback, selfsim, sensitivity, spread
from coastline.streaming import closed_loop

QUERIES, ORACLES = {}, {}
query = register_into(QUERIES, ORACLES)

_WIDE = "CASE WHEN {0} < 5 THEN 'excellent' WHEN {0} < 10 THEN 'good' WHEN {0} < 20 THEN 'fair' WHEN {0} IS NOT NULL THEN 'poor' END"


def _between(by: str, column: str, left: str, right: str) -> str:
    gain = "CASE WHEN l > 0 THEN (l - r) / l * 100 WHEN l IS NOT NULL AND r IS NOT NULL THEN 0e0 END"
    return (
        _L + f", e AS (SELECT {by}, CAST(count(error_pct) AS BIGINT) AS n, avg(error_pct) FILTER ({column} = '{left}') AS l, avg(error_pct) FILTER ({column} = '{right}') AS r FROM log WHERE {column} IN ('{left}', '{right}') GROUP BY {by}), "
        f"g AS (SELECT *, {gain} AS gain FROM e) SELECT {by}, n, round(l, 6) AS left_error, round(r, 6) AS right_error, round(l / nullif(r, 0), 6) AS error_ratio, round(gain, 6) + 0.0 AS improvement_pct, {_WIDE.format('l')} AS left_grade, {_WIDE.format('r')} AS right_grade, "
        "CASE WHEN gain > 15 THEN 'major' WHEN gain > 5 THEN 'moderate' WHEN gain > 0 THEN 'slight' WHEN gain IS NOT NULL THEN 'none' END AS improvement FROM g"
    )


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).withColumn("error_pct", feedback.error_percent())


@query(_between("interface_type", "implementation", "impl_F", "impl_O"))
def compare_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters set by hand against learned ones, per kind of curve."""
    return rounded(comparison.errors_between(_errors(spark, sf_dir), ["interface_type"], "implementation", "impl_F", "impl_O"))


@query(_between("implementation", "interface_type", "complex_fractal", "koch_curve"))
def compare_curve_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve that is hard to measure against one that is known to succeed, per implementation."""
    return rounded(comparison.errors_between(_errors(spark, sf_dir), ["implementation"], "interface_type", "complex_fractal", "koch_curve"))


#: Parameters that served in earlier measurements.
SERVED = {"initial_delta": 1.0, "delta_factor": 1.2, "num_steps": 15.0}
_ERROR = "(" + " + ".join(f"abs({{0}}.{n} - {v}e0) / {v}e0 * 100" for n, v in SERVED.items()) + ") / 3"


@query(
    f"""WITH t AS (SELECT * FROM ({curve_queries.ORACLES['heuristic_params']})), s AS (SELECT * FROM ({spectrum_queries.ORACLES['spectral_params']})),
e AS (SELECT curve_id, {_ERROR.format('t')} AS l, {_ERROR.format('s')} AS r FROM t JOIN s USING (curve_id))
SELECT curve_id, round(l, 6) AS left_error, round(r, 6) AS right_error, round(100 - l, 6) + 0.0 AS left_accuracy, round(100 - r, 6) + 0.0 AS right_accuracy, round(l - r, 6) + 0.0 AS gain, CASE WHEN l - r > 0 THEN 'right' WHEN l - r < 0 THEN 'left' ELSE 'same' END AS nearer FROM e"""
)
def compare_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters by geometry against those by the spectrum, per curve of ``events``."""
    plain, spectral = curve_queries.heuristic_params(spark, sf_dir), spectrum_queries.spectral_params(spark, sf_dir)
    actual = plain.select("curve_id", *[F.lit(v).alias(n) for n, v in SERVED.items()])
    return rounded(comparison.parameters_between(plain, spectral, actual))


@query(
    f"""WITH c AS (SELECT curve_id, avg(change_pct) AS m, max(change_pct) AS x FROM ({curve_queries.ORACLES['grid_half_shift']}) WHERE change_pct < 100 GROUP BY curve_id),
p AS (SELECT c.*, b.curve_id AS base_id, b.m AS bm, CASE WHEN b.m > 0 THEN c.m / b.m ELSE 'Infinity'::DOUBLE END AS ratio FROM c JOIN c b ON b.curve_id = CAST(CAST(c.curve_id AS BIGINT) // 10 * 10 AS VARCHAR) WHERE c.curve_id <> b.curve_id),
v AS (SELECT *, CASE WHEN m > 10 + 1e-9 THEN 1e0 WHEN m > 5 + 1e-9 THEN 0.5e0 ELSE 0e0 END + CASE WHEN ratio > 2 + 1e-9 THEN 1e0 WHEN ratio > 1.5e0 + 1e-9 THEN 0.5e0 ELSE 0e0 END + CASE WHEN x > 20 + 1e-9 THEN 1e0 ELSE 0e0 END AS evidence FROM p)
SELECT curve_id, base_id, round(m, 6) AS mean_change, round(x, 6) AS max_change, round(bm, 6) AS base_change, round(ratio, 6) AS ratio, evidence, CASE WHEN evidence >= 2 THEN 'confirmed' WHEN evidence >= 1 THEN 'partially confirmed' ELSE 'not confirmed' END AS verdict FROM v"""
)
def grid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far counts hang on the grid: each user's curve against the first user's of the same ten."""
    changes = curve_queries.grid_half_shift(spark, sf_dir)
    base = (F.floor(F.col("curve_id").cast("bigint") / 10) * 10).cast("string")
    pairs = changes.select("curve_id", base.alias("base_id")).distinct().where("curve_id <> base_id")
    return rounded(sensitivity.evidence(changes, pairs))


_ROW = "hurst_sf r2_sf hurst_va r2_va hurst_dfa r2_dfa hurst_consensus scaling_min scaling_max scaling_quality self_similarity_strength"


@query(
    signal_queries._H + signal_queries._SR + f""", w AS (SELECT *, abs(hurst_consensus - 0.5e0) * scaling_quality AS self_similarity_strength, list_stddev_pop([hurst_sf, hurst_va, hurst_dfa]) AS spread FROM hc LEFT JOIN sr USING (series_id))
SELECT series_id, {', '.join(f'round({c}, 6) AS {c}' for c in _ROW.split())}, round(1 / 3e0, 6) AS hurst_confidence, round((r2_sf + r2_va + r2_dfa) / 3, 6) AS mean_r2, round(spread, 6) AS hurst_variation, 'uncertain' AS fractal_character,
  round(greatest(1e0, least(2e0, 2 - hurst_consensus)), 6) AS predicted_dimension, CASE WHEN hurst_consensus BETWEEN 0.95e0 AND 1.05e0 THEN 'brownian_motion' WHEN hurst_consensus > 1.05e0 THEN 'persistent_fractal' ELSE 'antipersistent_fractal' END AS fractal_type,
  CASE WHEN spread < 0.05e0 THEN 'monofractal' WHEN spread < 0.15e0 THEN 'weak_multifractal' ELSE 'strong_multifractal' END AS multifractal_character FROM w"""
)
def selfsim_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.row(signal_queries.signals(spark, sf_dir)).drop("n_estimates"))


@query(
    _L + """, r AS (SELECT interface_type, implementation, CASE WHEN record_id % 100 = 7 THEN true ELSE success END AS success, record_id % 100 = 7 AS curated FROM log)
SELECT implementation, interface_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (success) AS BIGINT) AS successes, CAST(count(*) FILTER (curated) AS BIGINT) AS n_curated FROM r GROUP BY implementation, interface_type"""
)
def feedback_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feedback through micro-batches into an exactly-once log; every hundredth record is then replaced by a curated one."""
    at = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    records = log(spark, sf_dir)
    files = max(4, -(-table(spark, sf_dir, "orders").count() // spread.ROWS))  # four batches, of as many files as keep each of them small
    records.drop("accuracy_score", "success", "failure_mode").repartitionByRange(files, "record_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{at}/in")
    running = closed_loop.sink(stream, f"{at}/log", f"{at}/state")
    running.awaitTermination()
    closed_loop.inject(records.where("record_id % 100 = 7").withColumn("success", F.lit(True)), f"{at}/log", 1)
    found = closed_loop.read(spark, f"{at}/log", "record_id")
    return found.groupBy("implementation", "interface_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"), F.count(closed_loop.VERSION).alias("n_curated"))
