"""Queries on a feedback log that is derived from the orders, with a row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.catalog.curve_queries import _TYPED
from coastline.catalog.registering import register_into
from coastline.catalog.tables import event_curves, rounded, table
from coastline.operators import consensus, features, feedback, rules

QUERIES, ORACLES = {}, {}
query = register_into(QUERIES, ORACLES)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    df = table(spark, sf_dir, "orders").selectExpr(
        f"{k} as record_id", f"lpad(cast({k} * 7919 % 100003 as string), 6, '0') as timestamp",
        f"element_at(array('koch_curve', 'straight_line', 'complex_fractal', 'simple_curve', 'moderate_fractal'), cast({k} % 5 as int) + 1) as interface_type", "concat('impl_', o_orderstatus) as implementation",
        f"named_struct('n_segments', cast(pow(4, 1 + {k} * 31 % 5) as bigint), 'tortuosity', 1 + ({k} % 7) / 2D + ({k} % 29) / 7D, 'mean_segment_length', ({k} % 23) / 40D, 'complexity_score', ({k} % 31) / 20D, 'direction_change_rate', ({k} % 9) / 10D, 'characteristic_length', 0.5D * (1 + {k} % 7) + ({k} % 5) / 10D, 'linearity_r_squared', 1 - ({k} % 4) / 8D - ({k} % 53) / 530D) as features",
        f"named_struct('initial_delta', 0.25D * (1 + {k} % 7), 'delta_factor', 1.25D + 0.25D * ({k} % 4), 'num_steps', cast(8 + {k} % 12 as double)) as suggested_parameters",
        f"case when {k} % 13 = 0 then null when {k} % 17 = 0 then double('NaN') else (1 + ({k} % 4) * 0.25D) * (1 + (({k} % 41) - 20) / 200D) end as dimension_result",
        f"case when {k} % 11 = 0 then null else 1 + ({k} % 4) * 0.25D end as theoretical_dimension", f"0.9D + ({k} % 10) * 0.01D as r_squared", f"({k} % 97) / 10D as computation_time",
    )
    return feedback.with_outcome(df)


_LOG = """raw AS (
  SELECT o_orderkey AS record_id, lpad(CAST(o_orderkey * 7919 % 100003 AS VARCHAR), 6, '0') AS timestamp,
    ['koch_curve', 'straight_line', 'complex_fractal', 'simple_curve', 'moderate_fractal'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS interface_type, 'impl_' || o_orderstatus AS implementation,
    CAST(pow(4, 1 + o_orderkey * 31 % 5) AS BIGINT) AS n_segments, 1 + (o_orderkey % 7) / 2e0 + (o_orderkey % 29) / 7e0 AS tortuosity, (o_orderkey % 23) / 40e0 AS mean_segment_length,
    (o_orderkey % 31) / 20e0 AS complexity_score, (o_orderkey % 9) / 10e0 AS direction_change_rate, 0.5e0 * (1 + o_orderkey % 7) + (o_orderkey % 5) / 10e0 AS characteristic_length, 1 - (o_orderkey % 4) / 8e0 - (o_orderkey % 53) / 530e0 AS linearity_r_squared,
    0.25e0 * (1 + o_orderkey % 7) AS initial_delta, 1.25e0 + 0.25e0 * (o_orderkey % 4) AS delta_factor, CAST(8 + o_orderkey % 12 AS DOUBLE) AS num_steps,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'NaN'::DOUBLE ELSE (1 + (o_orderkey % 4) * 0.25e0) * (1 + ((o_orderkey % 41) - 20) / 200e0) END AS dimension_result,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1 + (o_orderkey % 4) * 0.25e0 END AS theoretical_dimension, 0.9e0 + (o_orderkey % 10) * 0.01e0 AS r_squared
  FROM orders),
scored AS (
  SELECT *, dimension_result IS NOT NULL AND NOT isnan(dimension_result) AS ok,
    CASE WHEN dimension_result IS NOT NULL AND NOT isnan(dimension_result) AND theoretical_dimension IS NOT NULL THEN 1 - abs(dimension_result - theoretical_dimension) / theoretical_dimension END AS accuracy_score,
    CASE WHEN dimension_result IS NOT NULL AND NOT isnan(dimension_result) THEN abs(dimension_result - theoretical_dimension) / theoretical_dimension * 100 END AS error_pct FROM raw),
log AS (
  SELECT *, CASE WHEN NOT ok THEN false WHEN theoretical_dimension IS NOT NULL THEN accuracy_score > 0.95e0 ELSE coalesce(r_squared > 0.95e0, false) END AS success,
    CASE WHEN dimension_result IS NULL THEN 'no_result' WHEN isnan(dimension_result) THEN 'nan_result' END AS failure_mode FROM scored)"""
_L = f"WITH {_LOG} "


def _stats(names: str, where: str = "") -> str:
    f = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
    return ", ".join(f"round({f[n]}({p}){where}, 6) AS {p}_{n}" for p in feedback.PARAMETERS for n in names.split())


@query(_L + "SELECT record_id, round(accuracy_score, 9) AS accuracy_score, success, failure_mode FROM log")
def feedback_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(log(spark, sf_dir).select("record_id", "accuracy_score", "success", "failure_mode"), 9)


@query(_L + "SELECT record_id, round(error_pct, 6) AS error_pct, CASE WHEN error_pct < 2 THEN 'excellent' WHEN error_pct < 5 THEN 'good' WHEN error_pct < 10 THEN 'fair' ELSE 'poor' END AS grade, CASE WHEN r_squared > 0.99 THEN 'excellent' WHEN r_squared > 0.95e0 THEN 'good' WHEN r_squared > 0.90e0 THEN 'fair' ELSE 'poor' END AS fit FROM log WHERE error_pct IS NOT NULL")
def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir).withColumn("error_pct", feedback.error_percent()).where("error_pct is not null")
    return rounded(df.select("record_id", "error_pct", rules.error_grade(F.col("error_pct")).alias("grade"), rules.fit_grade(F.col("r_squared")).alias("fit")))


@query(
    _L + f"SELECT implementation, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (success) AS BIGINT) AS successes, CAST(count(*) FILTER (NOT success) AS BIGINT) AS failures, "
    f"round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS success_rate, {_stats('mean std min max', ' FILTER (success)')} FROM log GROUP BY implementation"
)
def success_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.success_patterns(log(spark, sf_dir)))


@query(
    _L + "SELECT interface_type, implementation, CAST(count(*) AS BIGINT) AS n_records, CAST(count(*) FILTER (success) AS BIGINT) AS n_success, "
    + ", ".join(f"round(avg({p}) FILTER (success), 6) AS learned_{p}" for p in feedback.PARAMETERS) + " FROM log GROUP BY interface_type, implementation"
)
def refined_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.learned_parameters(log(spark, sf_dir)))


@query(
    _L + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY implementation ORDER BY timestamp DESC, record_id DESC) AS rn FROM log),
recent AS (SELECT implementation, CAST(count(*) AS BIGINT) AS n_recent, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS recent_success_rate FROM ranked WHERE rn <= 10 GROUP BY implementation)
SELECT implementation, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (success) AS BIGINT) AS successes, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS success_rate, n_recent,
  round(recent_success_rate, 6) AS recent_success_rate FROM log JOIN recent USING (implementation) GROUP BY implementation, n_recent, recent_success_rate"""
)
def learning_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.learning_status(log(spark, sf_dir)))


@query(
    _TYPED + f""", {_LOG}, learned AS (SELECT interface_type, count(*) AS n, count(*) FILTER (success) AS s, avg(initial_delta) FILTER (success) AS d, avg(delta_factor) FILTER (success) AS f, avg(num_steps) FILTER (success) AS k
  FROM log WHERE implementation = 'impl_F' GROUP BY interface_type)
SELECT curve_id, interface_type, CASE WHEN n IS NULL THEN 'fallback' WHEN s = 0 THEN 'conservative' ELSE 'learned' END AS source,
  round(CASE WHEN n IS NULL THEN CASE WHEN interface_type = 'straight_line' THEN 0.5e0 WHEN interface_type IN ('complex_fractal', 'moderate_fractal', 'koch_curve') THEN 1e0 ELSE 0.8e0 END
    WHEN s = 0 THEN least(coalesce(mean_segment_length, 0.1e0), 0.25e0) ELSE d END, 6) AS initial_delta,
  round(CASE WHEN n IS NULL THEN CASE WHEN interface_type = 'straight_line' THEN 1.8e0 WHEN interface_type IN ('complex_fractal', 'moderate_fractal', 'koch_curve') THEN 1.2e0 ELSE 1.5e0 END WHEN s = 0 THEN 1.2e0 ELSE f END, 6) AS delta_factor,
  CAST(CASE WHEN n IS NULL THEN CASE WHEN interface_type IN ('straight_line', 'complex_fractal', 'moderate_fractal', 'koch_curve') THEN 15 ELSE 12 END WHEN s = 0 THEN 8 ELSE floor(k) END AS INTEGER) AS num_steps,
  interface_type <> 'straight_line' AS rotation_enabled
FROM typed LEFT JOIN learned USING (interface_type)"""
)
def adaptive_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = rules.classify(features.features(event_curves(spark, sf_dir)))
    out = feedback.adaptive_parameters(typed, log(spark, sf_dir), "impl_F")
    return rounded(out.select("curve_id", "interface_type", "source", "initial_delta", "delta_factor", "num_steps", "rotation_enabled"))


_U = _L + ", u AS (SELECT * FROM log WHERE ok AND theoretical_dimension IS NOT NULL) "
_BEST = ", ".join(f"arg_min({p}, struct_pack(e := error_pct, r := record_id)) AS best_{p}" for p in feedback.PARAMETERS)


@query(_U + f"SELECT interface_type, CAST(count(*) AS BIGINT) AS n, round(min(error_pct), 6) AS min_error, round(avg(error_pct), 6) AS avg_error, round(stddev_pop(error_pct), 6) AS std_error, round(avg(r_squared), 6) AS avg_r_squared, {_BEST} FROM u GROUP BY interface_type")
def accuracy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.accuracy_by_type(log(spark, sf_dir)))


_T = "struct_pack(t := timestamp, r := record_id)"


@query(
    _L + "SELECT interface_type, CAST(count(*) AS BIGINT) AS n, "
    + ", ".join(f"arg_min({p}, {_T}) AS first_{p}, arg_max({p}, {_T}) AS last_{p}, CAST(count(DISTINCT {p}) AS BIGINT) AS distinct_{p}" for p in feedback.PARAMETERS)
    + " FROM log GROUP BY interface_type"
)
def param_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.parameter_trend(log(spark, sf_dir)))


@query(
    _U + f", med AS (SELECT interface_type, quantile_cont(error_pct, 0.5) AS median_error FROM u GROUP BY interface_type) SELECT interface_type, round(median_error, 6) AS median_error, CAST(count(*) AS BIGINT) AS n, {_stats('min max mean')} "
    "FROM u JOIN med USING (interface_type) WHERE error_pct <= median_error GROUP BY interface_type, median_error"
)
def optimal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.optimal_ranges(log(spark, sf_dir)))


@query(_L + "SELECT implementation, CAST(count(*) AS BIGINT) AS total, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) * 100, 6) AS success_rate, CAST(count(error_pct) AS BIGINT) AS n_valid, round(avg(error_pct), 6) AS avg_error, round(min(error_pct), 6) AS min_error FROM log GROUP BY implementation")
def impl_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.implementation_comparison(log(spark, sf_dir)))


_K = _L + ", kl AS (SELECT *, CASE n_segments WHEN 4 THEN 1 WHEN 16 THEN 2 WHEN 64 THEN 3 WHEN 256 THEN 4 END AS level FROM log WHERE interface_type = 'koch_curve') "


@query(_K + "SELECT level, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (success) AS BIGINT) AS successes, round(min(error_pct), 6) AS min_error, round(avg(error_pct), 6) AS avg_error, arg_min(initial_delta, struct_pack(e := error_pct, r := record_id)) FILTER (error_pct IS NOT NULL) AS best_initial_delta FROM kl GROUP BY level")
def by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.by_level(log(spark, sf_dir)))


@query(_K + "SELECT printf('%.2f/%.2f/%d', initial_delta, delta_factor, CAST(num_steps AS BIGINT)) AS signature, level, CAST(count(*) AS BIGINT) AS n, round(avg(error_pct), 6) AS avg_error FROM kl WHERE error_pct IS NOT NULL GROUP BY signature, level")
def param_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir)
    return rounded(feedback.parameter_matrix(df))


@query(_K + "SELECT level, round(min(error_pct), 6) AS best_error, round(avg(error_pct), 6) AS avg_error, CAST(pow(4, level) AS BIGINT) AS segments, CASE WHEN avg(error_pct) < 10 THEN 'good' WHEN avg(error_pct) < 15 THEN 'moderate' ELSE 'poor' END AS grade FROM kl WHERE error_pct IS NOT NULL AND level IS NOT NULL GROUP BY level")
def level_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.level_complexity(log(spark, sf_dir)))


@query(_L + f"SELECT success, CAST(count(*) AS BIGINT) AS n, {_stats('mean std')}, round(avg(error_pct), 6) AS avg_error, CAST(count(*) FILTER (error_pct < 10) AS BIGINT) AS n_small_errors FROM log GROUP BY success")
def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.pattern_stats(log(spark, sf_dir)))


@query(_L + "SELECT interface_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (success) AS BIGINT) AS successes, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS success_rate FROM log GROUP BY interface_type")
def success_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.success_by_type(log(spark, sf_dir)))


@query(_L + "SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(7 AS BIGINT) AS n_features, CASE WHEN count(*) < 20 THEN 'insufficient' WHEN count(*) < 30 THEN 'limited' ELSE 'ready' END AS readiness FROM log")
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feature_coverage(log(spark, sf_dir))


CORRELATED = ("tortuosity", "complexity_score", "direction_change_rate", "mean_segment_length", "characteristic_length", "linearity_r_squared")
_PAIRS = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{p}' AS parameter, CAST({f} AS DOUBLE) AS x, {p} AS y FROM log" for f in CORRELATED for p in feedback.PARAMETERS)
#: p by integrating the t distribution's density: with u = atan(t / sqrt(n - 2)) it is a power of the cosine, over 20,000 even steps.
_CORR = f"""{_L}, pairs AS ({_PAIRS}), c AS (SELECT feature, parameter, CAST(count(*) AS BIGINT) AS n, corr(y, x) AS r FROM pairs GROUP BY feature, parameter),
u AS (SELECT *, n - 2 AS df, atan(abs(r) / sqrt(1 - r * r)) / 20000 AS h FROM c),
w AS (SELECT feature, parameter, n, r, df, h, sum(CASE WHEN i = 0 OR i = 20000 THEN 0.5e0 ELSE 1e0 END * pow(cos(h * i), df - 1)) AS s FROM u, (SELECT unnest(range(0, 20001)) AS i) GROUP BY feature, parameter, n, r, df, h),
p AS (SELECT feature, parameter, n, r, greatest(0e0, 1 - 2 * s * h * exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(pi())) AS p FROM w) """


def _flat(df: DataFrame) -> DataFrame:
    return df.select("record_id", "features.*", "suggested_parameters.*")


def _correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.correlations(_flat(log(spark, sf_dir)), list(CORRELATED), list(feedback.PARAMETERS))


@query(_CORR + "SELECT feature, parameter, n, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, CASE WHEN p < 0.01e0 THEN '**' WHEN p < 0.05e0 THEN '*' ELSE '' END AS stars FROM p")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_correlations(spark, sf_dir))


@query(_CORR + "SELECT feature, parameter, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, CASE WHEN r > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM p WHERE abs(r) > 0.3e0 AND p < 0.05e0")
def pearson_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.strong(_correlations(spark, sf_dir)))


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as curve_id", "element_at(array('spectrum', 'wavelet', 'curvature', 'self_similarity', 'traditional', 'other', 'none'), l_linenumber) as method",
        "case when l_linenumber = 6 then double('NaN') else l_extendedprice / 99991 end as initial_delta", "1 + l_discount * 9.7D as delta_factor", "cast(l_quantity as double) as num_steps",
        "case when l_partkey % 5 = 0 then 0D else l_tax * 10 end as confidence",
    )


_METHODS = """m AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS curve_id, ['spectrum', 'wavelet', 'curvature', 'self_similarity', 'traditional', 'other', 'none'][l_linenumber] AS method,
    CASE WHEN l_linenumber = 6 THEN 'NaN'::DOUBLE ELSE l_extendedprice / 99991 END AS initial_delta, 1 + l_discount * 9.7e0 AS delta_factor, CAST(l_quantity AS DOUBLE) AS num_steps,
    CASE WHEN l_partkey % 5 = 0 THEN 0e0 ELSE l_tax * 10 END AS confidence FROM lineitem)"""


@query(
    f"""WITH {_METHODS}, v AS (SELECT *, CASE method WHEN 'spectrum' THEN 0.25e0 WHEN 'wavelet' THEN 0.25e0 WHEN 'curvature' THEN 0.2e0 WHEN 'self_similarity' THEN 0.25e0 WHEN 'traditional' THEN 0.05e0 ELSE 0.2e0 END * confidence AS w
  FROM m WHERE confidence > 0 AND NOT isnan(initial_delta)),
a AS (SELECT curve_id, count(*) AS n, sum(w * initial_delta) / sum(w) AS d, sum(w * delta_factor) / sum(w) AS f, sum(w * num_steps) / sum(w) AS k, avg(confidence) AS c FROM v GROUP BY curve_id)
SELECT i.curve_id, CAST(coalesce(n, 0) AS BIGINT) AS n_methods, round(CASE WHEN n > 0 THEN greatest(1e-6, least(1e6, d)) ELSE 0.01e0 END, 9) AS initial_delta, round(CASE WHEN n > 0 THEN greatest(1.1e0, least(3e0, f)) ELSE 1.5e0 END, 9) AS delta_factor,
  CAST(CASE WHEN n > 0 THEN greatest(5e0, least(50e0, round_even(k, 0))) ELSE 12e0 END AS INTEGER) AS num_steps, round(CASE WHEN n > 0 THEN c ELSE 0.1e0 END, 9) AS confidence
FROM (SELECT DISTINCT curve_id FROM m) i LEFT JOIN a USING (curve_id)"""
)
def consensus_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.consensus(_methods(spark, sf_dir)), 9)


@query(f"WITH {_METHODS} SELECT method, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (confidence > 0) AS BIGINT) AS n_valid, round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence FROM m GROUP BY method")
def consensus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.summary(_methods(spark, sf_dir)))


@query(
    _TYPED + """, h AS (SELECT curve_id, CASE interface_type WHEN 'straight_line' THEN mean_segment_length * 8 WHEN 'extreme_turning_fractal' THEN characteristic_length * 0.03e0 WHEN 'high_turning_fractal' THEN characteristic_length * 0.05e0
    WHEN 'koch_curve' THEN characteristic_length * 0.1e0 WHEN 'complex_fractal' THEN characteristic_length * 0.2e0 WHEN 'moderate_fractal' THEN characteristic_length * 0.2e0 ELSE characteristic_length * 0.3e0 END AS d,
  CASE interface_type WHEN 'extreme_turning_fractal' THEN 1.3e0 WHEN 'high_turning_fractal' THEN 1.4e0 WHEN 'simple_curve' THEN 1.5e0 ELSE 1.8e0 END AS f,
  CASE interface_type WHEN 'straight_line' THEN 25 WHEN 'extreme_turning_fractal' THEN 35 WHEN 'high_turning_fractal' THEN 30 WHEN 'koch_curve' THEN 30 WHEN 'simple_curve' THEN 15 ELSE 20 END AS k FROM typed),
e AS (SELECT curve_id, (abs(d - 1) / 1 * 100 + abs(f - 1.5e0) / 1.5e0 * 100 + abs(k - 15) / 15e0 * 100) / 3 AS error_pct FROM h)
SELECT curve_id, round(error_pct, 6) AS error_pct, CASE WHEN error_pct < 50 THEN 'good' WHEN error_pct < 100 THEN 'fair' ELSE 'poor' END AS grade FROM e"""
)
def parameter_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = rules.heuristic_parameters(rules.classify(features.features(event_curves(spark, sf_dir))))
    actual = guess.select("curve_id", F.lit(1.0).alias("initial_delta"), F.lit(1.5).alias("delta_factor"), F.lit(15).alias("num_steps"))
    return rounded(consensus.parameter_error(guess, actual))
