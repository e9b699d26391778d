"""Queries on curvature, self-similarity, spectra and wavelets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.catalog import sql
from coastline.catalog.registering import register_into
from coastline.catalog.tables import event_curves, rounded, table
from coastline.operators import curvature, quantiles, selfsim, spread

QUERIES, ORACLES = {}, {}
query = register_into(QUERIES, ORACLES)
_SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)

_UNIQUE = """ends AS (SELECT curve_id, seg_idx * 2 AS p, x1 AS x, y1 AS y FROM segs UNION ALL SELECT curve_id, seg_idx * 2 + 1, x2, y2 FROM segs),
firsts AS (SELECT curve_id, x, y, min(p) AS f FROM ends GROUP BY curve_id, x, y),
pt AS (SELECT curve_id, x, y, CAST(row_number() OVER (PARTITION BY curve_id ORDER BY x, f) AS BIGINT) AS pos, CAST(count(*) OVER (PARTITION BY curve_id) AS BIGINT) AS n FROM firsts)"""


def _grad(name: str, source: str, columns: str) -> str:
    pieces = [f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS d{c}" for c in columns.split()]
    return f"{name} AS (SELECT *, {', '.join(pieces)} FROM {source} WINDOW w AS (PARTITION BY curve_id ORDER BY pos))"


_FD = f"{_UNIQUE}, {_grad('g1', 'pt', 'x y')}, {_grad('g2', 'g1', 'dx dy')}, kap AS (SELECT curve_id, pos, n, abs(dx * ddy - dy * ddx) / greatest(pow(dx * dx + dy * dy, 1.5e0), 1e-10) AS c FROM g2 WHERE n >= 3)"


@query(f"WITH {sql.EVENT_CURVES}, {_FD} SELECT curve_id, pos, n, round(c, 6) AS curvature FROM kap")
def curvature_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curvature.finite_difference(curvature.unique_points(event_curves(spark, sf_dir))))


@query(
    f"""WITH {sql.EVENT_CURVES}, {_UNIQUE}, t AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pt WHERE n >= 3 WINDOW w AS (PARTITION BY curve_id ORDER BY pos)),
k AS (SELECT *, CASE WHEN x0 IS NOT NULL AND x2 IS NOT NULL THEN 2 * abs((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0)) / (sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) * sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) * sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0))) END AS c FROM t)
SELECT curve_id, pos, n, round(CASE WHEN x0 IS NULL THEN lead(c) OVER w WHEN x2 IS NULL THEN lag(c) OVER w ELSE c END, 6) AS curvature FROM k WINDOW w AS (PARTITION BY curve_id ORDER BY pos)"""
)
def curvature_3pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curvature.three_point(curvature.unique_points(event_curves(spark, sf_dir))))


@query(
    f"""WITH {sql.EVENT_CURVES}, {_UNIQUE}, near AS (SELECT a.curve_id, a.pos, a.n, b.x, b.y FROM pt a JOIN pt b ON a.curve_id = b.curve_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 WHERE a.n >= 3),
c AS (SELECT curve_id, pos, n, x - avg(x) OVER g AS u, y - avg(y) OVER g AS v FROM near WINDOW g AS (PARTITION BY curve_id, pos)),
m AS (SELECT curve_id, pos, n, count(*) AS k, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) / 2 AS ru, sum(v * (u * u + v * v)) / 2 AS rv FROM c GROUP BY curve_id, pos, n),
r AS (SELECT *, sqrt(pow((ru * vv - rv * uv) / (uu * vv - uv * uv), 2) + pow((rv * uu - ru * uv) / (uu * vv - uv * uv), 2) + (uu + vv) / k) AS radius FROM m)
SELECT curve_id, pos, n, round(CASE WHEN k >= 3 AND uu * vv - uv * uv > 1e-14 * (uu + vv) * (uu + vv) AND radius > 1e-10 THEN 1 / radius ELSE 0e0 END, 6) AS curvature FROM r"""
)
def circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curvature.circle_fit(curvature.unique_points(event_curves(spark, sf_dir))))


_KF = f"""{_FD}, kw AS (
  SELECT *, CAST(least(5, n // 3) AS BIGINT) AS w FROM kap),
kl AS (
  SELECT *, CASE w WHEN 2 THEN CASE WHEN count(*) OVER a2 = 2 THEN stddev_pop(c) OVER a2 END WHEN 3 THEN CASE WHEN count(*) OVER a3 = 3 THEN stddev_pop(c) OVER a3 END
    WHEN 4 THEN CASE WHEN count(*) OVER a4 = 4 THEN stddev_pop(c) OVER a4 END WHEN 5 THEN CASE WHEN count(*) OVER a5 = 5 THEN stddev_pop(c) OVER a5 END END AS loc
  FROM kw WINDOW a2 AS (PARTITION BY curve_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), a3 AS (PARTITION BY curve_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
    a4 AS (PARTITION BY curve_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), a5 AS (PARTITION BY curve_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
kq AS (SELECT curve_id, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.75) AS q3, avg(c) AS mu FROM kap GROUP BY curve_id),
ka AS (
  SELECT curve_id, avg(c) AS mean_curvature, var_pop(c) AS curvature_variance, max(c) AS max_curvature, max(c) - min(c) AS curvature_range, count(*) FILTER (c > q3) / CAST(count(*) AS DOUBLE) AS high_curvature_fraction,
    avg(pow(c - mu, 3)) / pow(var_pop(c), 1.5e0) AS curvature_skewness, CASE WHEN count(*) > 3 THEN avg(pow(c - mu, 4)) / pow(var_pop(c), 2) - 3 END AS curvature_kurtosis,
    CASE WHEN max(n) > 5 THEN avg(loc) ELSE var_pop(c) END AS local_complexity_variation, count(*) FILTER (c < q1) / CAST(count(*) AS DOUBLE) AS smooth_region_fraction
  FROM kl JOIN kq USING (curve_id) GROUP BY curve_id)"""
_K_NAMES = "mean_curvature curvature_variance max_curvature curvature_range high_curvature_fraction curvature_skewness curvature_kurtosis local_complexity_variation smooth_region_fraction"


@query(f"WITH {sql.EVENT_CURVES}, {_KF} SELECT curve_id, {sql.rounded(_K_NAMES)} FROM ka")
def curvature_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curvature.features(event_curves(spark, sf_dir)).drop("curvature_percentiles"))


_KP = f"""{_KF}, kd AS (SELECT ka.*, width AS s FROM ka JOIN (SELECT curve_id, max(greatest(x1, x2)) - min(least(x1, x2)) AS width FROM segs GROUP BY curve_id) USING (curve_id))"""


@query(
    f"""WITH {sql.EVENT_CURVES}, {_KP} SELECT curve_id,
  round(greatest(0.001e0 * s, least(0.2e0 * s, CASE WHEN mean_curvature > 0 THEN 0.5e0 / mean_curvature * CASE WHEN smooth_region_fraction > 0.7 THEN 2e0 WHEN smooth_region_fraction < 0.3 THEN 0.5e0 ELSE 1e0 END ELSE 0.05e0 * s END)), 6) AS initial_delta,
  round(greatest(1.1e0, least(2e0, CASE WHEN max_curvature > 0 AND mean_curvature > 0 THEN CASE WHEN max_curvature / mean_curvature > 10 THEN 1.3e0 WHEN max_curvature / mean_curvature > 5 THEN 1.4e0 WHEN max_curvature / mean_curvature > 2 THEN 1.5e0 ELSE 1.7e0 END ELSE 1.5e0 END
    * CASE WHEN high_curvature_fraction > 0.5 THEN 0.9e0 WHEN high_curvature_fraction < 0.2 THEN 1.1e0 ELSE 1e0 END * CASE WHEN local_complexity_variation > 0.5e0 * curvature_variance THEN 0.95e0 ELSE 1e0 END)), 6) AS delta_factor,
  CAST(greatest(8e0, least(25e0, floor(12 * CASE WHEN curvature_variance > mean_curvature * mean_curvature THEN 1.4e0 WHEN curvature_variance > 0.5e0 * mean_curvature * mean_curvature THEN 1.2e0 ELSE 1e0 END
    * CASE WHEN high_curvature_fraction > 0.4 THEN 1.3e0 WHEN high_curvature_fraction > 0.2 THEN 1.1e0 ELSE 0.9e0 END * CASE WHEN local_complexity_variation > curvature_variance THEN 1.2e0 ELSE 1e0 END + 1e-9))) AS INTEGER) AS num_steps,
  round((CASE WHEN curvature_kurtosis IS NULL THEN 1e0 ELSE 1e0 END) * CASE WHEN max_curvature / mean_curvature BETWEEN 1 AND 100 THEN 1e0 WHEN max_curvature / mean_curvature > 1000 THEN 0.6e0 ELSE 0.8e0 END
    * CASE WHEN high_curvature_fraction + smooth_region_fraction BETWEEN 0.3e0 AND 1e0 THEN 1e0 ELSE 0.8e0 END, 6) AS confidence FROM kd"""
)
def curvature_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = event_curves(spark, sf_dir)
    scale = segs.groupBy("curve_id").agg(F.expr("max(greatest(x1, x2)) - min(least(x1, x2))").alias("domain_scale"))
    out = curvature.confidence(curvature.parameters(curvature.features(segs).join(scale, "curve_id")))
    return rounded(out.select("curve_id", "initial_delta", "delta_factor", "num_steps", "confidence"))


@query(
    f"""WITH {sql.EVENT_CURVES}, {_KF} SELECT curve_id, CASE WHEN mean_curvature < 0.1e0 THEN 'very_smooth' WHEN mean_curvature < 1 THEN 'smooth' WHEN mean_curvature < 10 THEN 'moderate_complexity' WHEN mean_curvature < 100 THEN 'high_complexity' ELSE 'very_high_complexity' END AS complexity_class,
  CASE WHEN curvature_skewness > 2 THEN 'highly_skewed_right' WHEN curvature_skewness > 0.5e0 THEN 'skewed_right' WHEN curvature_skewness > -0.5e0 THEN 'symmetric' WHEN curvature_skewness > -2 THEN 'skewed_left' ELSE 'highly_skewed_left' END AS distribution_type,
  round(1 / (1 + curvature_variance), 6) AS uniformity, round(least(0.1e0 / mean_curvature, 1e0), 6) AS min_box_size, round(least(1 / mean_curvature, 10e0), 6) AS max_box_size,
  CASE WHEN smooth_region_fraction > 0.6e0 THEN 'smooth' WHEN smooth_region_fraction < 0.3e0 THEN 'complex' ELSE 'mixed' END AS smoothness FROM ka"""
)
def curvature_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curvature.complexity(curvature.features(event_curves(spark, sf_dir)))
    return rounded(out.select("curve_id", "complexity_class", "distribution_type", "uniformity", "min_box_size", "max_box_size", "smoothness"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a signal."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("series_id"), F.posexplode("embedding").alias("idx", "value"))
    return df.select("series_id", F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("double").alias("value"))


_SIG = """raw0 AS (SELECT CAST(vec_id AS VARCHAR) AS series_id, embedding, len(embedding) AS n FROM embeddings),
nn AS MATERIALIZED (SELECT unnest(range(0, 4096)) AS i),
sig AS (SELECT series_id, CAST(i AS BIGINT) AS idx, n, CAST(embedding[i + 1] AS DOUBLE) AS value FROM raw0 JOIN nn ON i < n)"""
_SF = """, sf AS (SELECT a.series_id, b.idx - a.idx AS lag, avg(pow(abs(b.value - a.value), 2)) AS v FROM {t} a JOIN {t} b ON a.series_id = b.series_id AND b.idx > a.idx AND b.idx - a.idx <= least(a.n // 4, 50) GROUP BY a.series_id, b.idx - a.idx)"""
_Z = ", st AS (SELECT series_id, avg(value) AS mu, stddev_pop(value) AS sd FROM sig GROUP BY series_id), z AS (SELECT series_id, idx, n, (value - mu) / CASE WHEN sd > 0 THEN sd ELSE 1e0 END AS value FROM sig JOIN st USING (series_id))"
_VA = """, vb AS (SELECT series_id, i AS b, idx // i AS blk, avg(value) AS m FROM {t} JOIN nn ON i >= 2 AND i <= least(n // 4, 50, n // 2 - 1) WHERE idx // i < n // i GROUP BY series_id, i, idx // i),
va AS (SELECT series_id, b, var_pop(m) AS v FROM vb GROUP BY series_id, b)"""
_DFA = """, pc AS (SELECT series_id, idx, n, value - avg(value) OVER (PARTITION BY series_id) AS d FROM {t}),
pr AS (SELECT series_id, idx, n, sum(d) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM pc),
db AS (SELECT series_id, i AS b, idx // i AS blk, regr_syy(y, idx) - regr_sxy(y, idx) * regr_sxy(y, idx) / regr_sxx(y, idx) AS ss FROM pr JOIN nn ON i >= 4 AND i <= least(n // 4, 50, n // 4 - 1) WHERE idx // i < n // i GROUP BY series_id, i, idx // i),
df AS (SELECT series_id, b, avg(sqrt(greatest(0e0, ss / b))) AS v FROM db GROUP BY series_id, b)"""
_LINE = "SELECT series_id, round({slope}, 6) AS hurst_{k}, round(regr_r2(log10(v), log10({x})), 6) AS r2_{k} FROM {t} WHERE v > 0 GROUP BY series_id HAVING count(*) >= 3"
_S = "regr_slope(log10(v), log10({x}))"


@query(f"WITH {_SIG}{_SF.format(t='sig')} SELECT series_id, lag, CAST((SELECT max(n) FROM raw0) AS BIGINT) AS n, round(v, 6) AS value FROM sf")
def structure_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.structure_function(signals(spark, sf_dir)))


@query(f"WITH {_SIG}{_SF.format(t='sig')} " + _LINE.format(slope=_S.format(x="lag") + " / 2", k="sf", x="lag", t="sf"))
def hurst_sf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.hurst_sf(signals(spark, sf_dir)))


@query(f"WITH {_SIG}{_VA.format(t='sig')} " + _LINE.format(slope="(" + _S.format(x="b") + " + 2) / 2", k="va", x="b", t="va"))
def hurst_va(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.hurst_va(signals(spark, sf_dir)))


@query(f"WITH {_SIG}{_DFA.format(t='sig')} " + _LINE.format(slope=_S.format(x="b"), k="dfa", x="b", t="df"))
def hurst_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.hurst_dfa(signals(spark, sf_dir)))


def _raw_line(slope: str, k: str, x: str, t: str) -> str:
    return f"SELECT series_id, {slope} AS hurst_{k}, regr_r2(log10(v), log10({x})) AS r2_{k} FROM {t} WHERE v > 0 GROUP BY series_id HAVING count(*) >= 3"


_H = f"""WITH {_SIG}{_Z}{_SF.format(t='z')}{_VA.format(t='z')}{_DFA.format(t='z')}, h AS (SELECT * FROM ({_raw_line(_S.format(x='lag') + ' / 2', 'sf', 'lag', 'sf')}) JOIN ({_raw_line('(' + _S.format(x='b') + ' + 2) / 2', 'va', 'b', 'va')}) USING (series_id)
JOIN ({_raw_line(_S.format(x='b'), 'dfa', 'b', 'df')}) USING (series_id)),
hc AS (SELECT *, (hurst_sf * r2_sf + hurst_va * r2_va + hurst_dfa * r2_dfa) / (r2_sf + r2_va + r2_dfa) AS hurst_consensus FROM h)"""


@query(_H + " SELECT series_id, round(hurst_consensus, 6) AS hurst_consensus, round(1 / 3e0, 6) AS hurst_confidence, round((r2_sf + r2_va + r2_dfa) / 3, 6) AS mean_r2 FROM hc")
def hurst_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.hurst(signals(spark, sf_dir)).select("series_id", "hurst_consensus", "hurst_confidence", "mean_r2"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events as a signal; numbered by ranges, so that a user of any size is spread."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series_id"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    return spread.numbered(e, "series_id", ["ts", "event_id"], "idx").select("series_id", "idx", "value")


_EVENT_SIG = """nn AS MATERIALIZED (SELECT unnest(range(0, 4096)) AS i),
sig AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, count(*) OVER (PARTITION BY user_id) AS n, CAST(value AS DOUBLE) AS value FROM events WHERE user_id IS NOT NULL)"""


@query(f"WITH {_EVENT_SIG}{_SF.format(t='sig')} SELECT series_id, lag, (SELECT count(*) FROM sig s WHERE s.series_id = sf.series_id) AS n, round(v * 1.000000000001e0, 4) AS value FROM sf")
def event_structure_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two decimals end in ties, which a little more than a half rounds up in both engines."""
    out = selfsim.structure_function(event_signals(spark, sf_dir))
    return rounded(out.withColumn("value", F.col("value") * 1.000000000001), 4)


@query(_H.replace(_SIG, _EVENT_SIG) + " SELECT series_id, round(hurst_consensus, 6) AS hurst_consensus, round((r2_sf + r2_va + r2_dfa) / 3, 6) AS mean_r2 FROM hc")
def event_hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.hurst(event_signals(spark, sf_dir)).where("n_estimates = 3").select("series_id", "hurst_consensus", "mean_r2"))


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, " + ", ".join(f"round(quantile_cont(CAST(value AS DOUBLE), {p}), 6) + 0.0 AS q{round(p * 100)}" for p in _SHARES) + " FROM events WHERE value IS NOT NULL GROUP BY event_type")
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the values of each type of event, of which there are few, with no type in one task."""
    out = quantiles.exact(table(spark, sf_dir, "events"), "event_type", "value", _SHARES)
    return rounded(out.select("event_type", "n", *[F.col("quantiles")[i].alias(f"q{round(p * 100)}") for i, p in enumerate(_SHARES)]))


@query(ORACLES["curvature_features"])
def curvature_features_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points numbered by ranges and windows over chunks: no task holds a curve."""
    return rounded(curvature.features(event_curves(spark, sf_dir), ranged=True).drop("curvature_percentiles"))


@query(
    _H + """ SELECT series_id, 'uncertain' AS fractal_character, round(greatest(1e0, least(2e0, 2 - hurst_consensus)), 6) AS predicted_dimension,
  CASE WHEN hurst_consensus BETWEEN 0.95e0 AND 1.05e0 THEN 'brownian_motion' WHEN hurst_consensus > 1.05e0 THEN 'persistent_fractal' ELSE 'antipersistent_fractal' END AS fractal_type,
  CASE WHEN list_stddev_pop([hurst_sf, hurst_va, hurst_dfa]) < 0.05e0 THEN 'monofractal' WHEN list_stddev_pop([hurst_sf, hurst_va, hurst_dfa]) < 0.15e0 THEN 'weak_multifractal' ELSE 'strong_multifractal' END AS multifractal_character FROM hc"""
)
def selfsim_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selfsim.properties(selfsim.character(selfsim.hurst(signals(spark, sf_dir))))
    return rounded(out.select("series_id", "fractal_character", "predicted_dimension", "fractal_type", "multifractal_character"))


#: All windows of five lags or more, from prefix sums; of the best fits the first by start and end.
_SR = """, sfr AS (SELECT a.series_id, b.idx - a.idx AS lag, avg(pow(abs(b.value - a.value), 2)) AS v FROM z a JOIN z b ON a.series_id = b.series_id AND b.idx > a.idx AND b.idx - a.idx <= least(a.n // 3, 100) WHERE a.n >= 20 GROUP BY a.series_id, b.idx - a.idx),
lg AS (SELECT series_id, lag, row_number() OVER w AS i, log10(lag) AS x, log10(v) AS y FROM sfr WHERE v > 0 WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
cs AS (SELECT series_id, lag, i, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(y * y) OVER w AS syy, sum(x * y) OVER w AS sxy FROM lg WINDOW w AS (PARTITION BY series_id ORDER BY i)),
st0 AS (SELECT series_id, i AS a, lag AS lo, sx, sy, sxx, syy, sxy FROM (SELECT series_id, i + 1 AS i, lead(lag) OVER (PARTITION BY series_id ORDER BY i) AS lag, sx, sy, sxx, syy, sxy FROM cs) WHERE lag IS NOT NULL
  UNION ALL SELECT series_id, 1, lag, 0, 0, 0, 0, 0 FROM cs WHERE i = 1),
wn AS (SELECT e.series_id, a, e.i AS b, lo, e.lag AS hi, e.i - a + 1 AS k, e.sx - s.sx AS sx, e.sy - s.sy AS sy, e.sxx - s.sxx AS sxx, e.syy - s.syy AS syy, e.sxy - s.sxy AS sxy FROM cs e JOIN st0 s ON s.series_id = e.series_id AND e.i >= a + 4),
ft AS (SELECT *, sxx - sx * sx / k AS cx, syy - sy * sy / k AS cy, sxy - sx * sy / k AS cxy FROM wn),
sr AS (SELECT series_id, CAST(lo AS DOUBLE) AS scaling_min, CAST(hi AS DOUBLE) AS scaling_max, cxy * cxy / (cx * cy) AS scaling_quality FROM ft WHERE cx > 0 AND cy > 0 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY cxy * cxy / (cx * cy) DESC, a, b) = 1)"""


@query(f"WITH {_SIG}{_Z}{_SR} SELECT series_id, scaling_min, scaling_max, round(scaling_quality, 6) AS scaling_quality FROM sr")
def scaling_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selfsim.scaling_range(selfsim.standardised(signals(spark, sf_dir)).drop("n")))


_DECADES = "CASE WHEN log10(scaling_max / scaling_min) > 2 THEN 1.4e0 WHEN log10(scaling_max / scaling_min) > 1 THEN 1.2e0 WHEN log10(scaling_max / scaling_min) > 0.5 THEN 1e0 ELSE 0.8e0 END"


@query(
    _H + _SR + f""", sp AS (SELECT series_id, hurst_consensus AS h, scaling_min, scaling_max, scaling_quality AS q, abs(hurst_consensus - 0.5e0) * scaling_quality AS t FROM hc JOIN sr USING (series_id))
SELECT series_id, greatest(0.001e0, least(0.2e0, 0.7e0 * sqrt(scaling_min * scaling_max))) AS initial_delta,
  round(greatest(1.1e0, least(2e0, 1.5e0 * CASE WHEN h BETWEEN 0.7e0 AND 1.3e0 THEN 1.2e0 WHEN h BETWEEN 0.5e0 AND 1.5e0 THEN 1.1e0 ELSE 0.9e0 END * CASE WHEN t > 0.5e0 THEN 1.2e0 WHEN t > 0.2e0 THEN 1.1e0 ELSE 0.9e0 END
    * CASE WHEN q > 0.9e0 THEN 1.1e0 WHEN q > 0.7e0 THEN 1e0 ELSE 0.95e0 END)), 6) AS delta_factor,
  CAST(greatest(8e0, least(30e0, floor(12 * {_DECADES} * 0.9e0 * CASE WHEN t > 0.4e0 THEN 1.1e0 ELSE 1e0 END + 1e-9))) AS INTEGER) AS num_steps FROM sp"""
)
def selfsim_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    out = selfsim.hurst(s).join(selfsim.scaling_range(selfsim.standardised(s).drop("n")), "series_id", "left")
    out = out.withColumns({"domain_scale": F.lit(1.0), "self_similarity_strength": F.abs(F.col("hurst_consensus") - 0.5) * F.col("scaling_quality")})
    return rounded(selfsim.parameters(out).select("series_id", "initial_delta", "delta_factor", "num_steps"))
