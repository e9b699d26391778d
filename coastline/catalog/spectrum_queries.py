"""Queries on height functions, spectra, wavelets and the consensus of all methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.catalog import sql
from coastline.catalog.registering import register_into
from coastline.catalog.tables import event_curves, rounded
from coastline.operators import spectrum
from coastline.plans import comprehensive

QUERIES, ORACLES = {}, {}
query = register_into(QUERIES, ORACLES)


def _heights(points: int) -> str:
    return f"""{sql.EVENT_CURVES}, hp AS (SELECT curve_id, x1 AS x, y1 AS y FROM segs UNION SELECT curve_id, x2, y2 FROM segs),
hs AS (SELECT *, min(x) OVER c AS x0, (max(x) OVER c - min(x) OVER c) / {points - 1} AS step FROM hp WINDOW c AS (PARTITION BY curve_id)),
hl AS (SELECT *, CAST(CASE WHEN step > 0 THEN least({points - 1}, ceil((x - x0) / step - 1e-9)) ELSE 0 END AS BIGINT) AS lo FROM hs),
hg AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, CASE WHEN lead(x) OVER o IS NULL THEN {points - 1} ELSE lead(lo) OVER o - 1 END AS hi FROM hl WINDOW o AS (PARTITION BY curve_id ORDER BY x, y)),
height AS (
  SELECT curve_id, CAST(i AS BIGINT) AS i, step, CASE WHEN x2 IS NULL OR x2 = x THEN y ELSE y + (y2 - y) * (x0 + i * step - x) / (x2 - x) END AS h
  FROM hg JOIN (SELECT unnest(range(0, {points})) AS i) ON i BETWEEN lo AND hi)"""


@query(f"WITH {_heights(64)} SELECT curve_id, i, round(step, 6) AS step, round(h, 6) + 0.0 AS height FROM height")
def height_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spectrum.height_function(event_curves(spark, sf_dir), 64).select("curve_id", "step", F.posexplode("heights").alias("i", "height"))
    return rounded(h.withColumn("i", F.col("i").cast("bigint")))


#: Welch's method written out: 7 half-overlapping Hann windows of 256 of the 1,024 heights, each without its mean, and their Fourier sums.
_PSD = f"""{_heights(1024)}, sg AS (SELECT curve_id, step, s, i - s * 128 AS j, h FROM height JOIN (SELECT unnest(range(0, 7)) AS s) ON i BETWEEN s * 128 AND s * 128 + 255),
sw AS (SELECT curve_id, step, s, j, (h - avg(h) OVER (PARTITION BY curve_id, s)) * (0.5e0 - 0.5e0 * cos(2 * pi() * j / 256)) AS v FROM sg),
trig AS (SELECT j, k, cos(2 * pi() * j * k / 256) AS c, sin(2 * pi() * j * k / 256) AS z FROM (SELECT unnest(range(0, 256)) AS j), (SELECT unnest(range(1, 129)) AS k)),
ft AS (SELECT curve_id, step, s, k, sum(v * c) AS re, sum(v * z) AS im FROM sw JOIN trig USING (j) GROUP BY curve_id, step, s, k),
psd AS (SELECT curve_id, step, k, k / (256 * step) AS f, avg(re * re + im * im) * CASE k WHEN 128 THEN 1 ELSE 2 END * step / 96 AS p FROM ft GROUP BY curve_id, step, k),
area AS (SELECT *, (p + lead(p) OVER w) / 2 * (lead(f) OVER w - f) AS a, (f * p + lead(f * p) OVER w) / 2 * (lead(f) OVER w - f) AS fa, lead(f) OVER w AS f2, sum(p) OVER w AS cum FROM psd WINDOW w AS (PARTITION BY curve_id ORDER BY k)),
marks AS (SELECT curve_id, sum(a) AS whole, sum(fa) AS firsts, sum(p) AS power, min(f) AS f1, max(f) AS fn, quantile_cont(f, 0.2) AS q20, quantile_cont(f, 0.5) AS q50, quantile_cont(f, 0.75) AS q75, quantile_cont(f, 0.8) AS q80 FROM area GROUP BY curve_id),
sf AS (
  SELECT curve_id, arg_max(f, p) AS dominant_frequency, -regr_slope(log10(p), log10(f)) FILTER (f BETWEEN q20 AND q80) AS spectral_slope, sum(a) FILTER (f > q75) / any_value(whole) AS high_freq_content,
    coalesce(min(f) FILTER (cum * f1 / whole >= 0.975e0 * (1 - 1e-9)), any_value(f1)) AS up, coalesce(min(f) FILTER (cum * f1 / whole >= 0.025e0 * (1 - 1e-9)), any_value(f1)) AS low, any_value(fn) - any_value(f1) AS span,
    any_value(firsts / whole) AS spectral_centroid, CASE WHEN min(k) FILTER (cum >= 0.95e0 * power * (1 - 1e-9)) > 1 THEN min(f) FILTER (cum >= 0.95e0 * power * (1 - 1e-9)) ELSE any_value(fn) END AS spectral_rolloff,
    sum(a) FILTER (f2 <= q50) / sum(a) FILTER (f > q50) AS low_high_ratio, any_value(step) * 1023 AS domain_scale
  FROM area JOIN marks USING (curve_id) GROUP BY curve_id),
feat AS (SELECT *, CASE WHEN up > low THEN up - low ELSE span END AS spectral_bandwidth, dominant_frequency / spectral_centroid AS peak_ratio FROM sf)"""


def _heights_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.height_function(event_curves(spark, sf_dir), 1024)


#: Frequencies are multiples of a step and often end in a five after the sixth place: a little more than a half is rounded up by both engines.
_UP = "1.000000000001"


@query(f"WITH {_PSD} SELECT curve_id, {', '.join(f'round({c} * {_UP}e0, 6) + 0.0 AS {c}' for c in spectrum.SPECTRAL)} FROM feat")
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.spectral_features(_heights_of(spark, sf_dir)).drop("error")
    return rounded(out.withColumns({c: F.col(c) * float(_UP) for c in spectrum.SPECTRAL}))


@query(
    f"""WITH {_PSD} SELECT curve_id, round(greatest(0.001e0 * domain_scale, least(0.2e0 * domain_scale, domain_scale / (10 * dominant_frequency))), 6) AS initial_delta,
  round(CASE WHEN spectral_slope > 2.5e0 THEN 1.8e0 WHEN spectral_slope > 1.5e0 THEN 1.5e0 WHEN spectral_slope > 0.5e0 THEN 1.3e0 ELSE 1.2e0 END * CASE WHEN high_freq_content > 0.3e0 THEN 0.9e0 ELSE 1e0 END, 6) AS delta_factor,
  CAST(greatest(8e0, least(25e0, floor(12 * (CASE WHEN spectral_bandwidth > 2 * dominant_frequency * (1 + 1e-9) THEN 1.5e0 WHEN spectral_bandwidth < 0.5e0 * dominant_frequency * (1 - 1e-9) THEN 0.7e0 ELSE 1e0 END
    * CASE WHEN spectral_slope > 2 THEN 1.3e0 WHEN spectral_slope < 1 THEN 0.8e0 ELSE 1e0 END)))) AS INTEGER) AS num_steps,
  round(CASE WHEN spectral_slope BETWEEN 0.5e0 AND 3e0 THEN 1e0 ELSE 0.7e0 END * CASE WHEN peak_ratio > 1.5e0 THEN 1e0 WHEN peak_ratio > 1.2e0 THEN 0.9e0 ELSE 0.7e0 END, 6) AS confidence FROM feat"""
)
def spectral_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _heights_of(spark, sf_dir)
    scale = h.select("curve_id", (F.col("step") * (F.size("heights") - 1)).alias("domain_scale"))
    out = spectrum.spectral_parameters(spectrum.spectral_features(h).join(scale, "curve_id"))
    return rounded(out.select("curve_id", "initial_delta", "delta_factor", "num_steps", "confidence"))


#: The transform written out: each of 32 scales has a kernel of up to 512 steps, joined to the standardised heights modulo their number.
#: Where on the circle a kernel starts makes no difference to its energy, nor to its greatest and mean size.
_CWT = f"""{_heights(spectrum.POINTS)}, zs AS (SELECT curve_id, i, (h - avg(h) OVER c) / nullif(stddev_pop(h) OVER c, 0) AS z FROM height WINDOW c AS (PARTITION BY curve_id)),
scales AS MATERIALIZED (SELECT curve_id, k, domain, domain / 256 * pow(64e0, k / 31e0) AS s FROM (SELECT curve_id, any_value(step) * 511 AS domain FROM height GROUP BY curve_id), (SELECT unnest(range(0, 32)) AS k)),
steps AS (SELECT *, CAST(ceil(6 * s * (1 - 1e-9)) AS BIGINT) AS n FROM scales),
taps AS (SELECT *, unnest(range(greatest(0, n // 2 - 256), least(n, greatest(0, n // 2 - 256) + 512))) AS m FROM steps),
kernel AS MATERIALIZED (
  SELECT curve_id, k, m, cos(12 * pi() * u) * exp(-u * u / 2) / sqrt(s * pow(pi(), 0.25e0)) AS re, -sin(12 * pi() * u) * exp(-u * u / 2) / sqrt(s * pow(pi(), 0.25e0)) AS im
  FROM (SELECT *, m / s - 3 AS u FROM taps)),
folded AS MATERIALIZED (SELECT curve_id, k, ((i - m) % 512 + 512) % 512 AS p, sum(z * re) AS re, sum(z * im) AS im FROM kernel JOIN zs USING (curve_id) WHERE z IS NOT NULL GROUP BY curve_id, k, p),
sizes AS (SELECT curve_id, k, avg(re * re + im * im) AS e, max(sqrt(re * re + im * im)) / (avg(sqrt(re * re + im * im)) + 1e-10) AS burst FROM folded GROUP BY curve_id, k),
shares AS MATERIALIZED (
  SELECT curve_id, k, s, domain, burst, p, sum(p) OVER (PARTITION BY curve_id ORDER BY k) AS cum, sum(p) OVER (PARTITION BY curve_id ORDER BY p, k) AS ordered,
    p >= 0.05e0 AND p > lag(p) OVER o AND p > lead(p) OVER o AS peak
  FROM (SELECT curve_id, k, s, domain, burst, e / sum(e) OVER (PARTITION BY curve_id) AS p FROM sizes JOIN scales USING (curve_id, k)) WINDOW o AS (PARTITION BY curve_id ORDER BY k)),
wf AS (
  SELECT curve_id, any_value(domain) AS domain_scale, -sum(p * log2(p)) FILTER (p > 0) AS wavelet_entropy, avg(burst) AS intermittency, var_pop(p) AS multiscale_complexity, (33 - 2 * sum(ordered) / max(ordered)) / 32 AS energy_concentration,
    min(s) FILTER (cum >= 0.1e0 * (1 - 1e-9)) AS low, min(s) FILTER (cum >= 0.9e0 * (1 - 1e-9)) AS up, max(s) - min(s) AS span, sum(p) FILTER (k < 10) / sum(p) FILTER (k >= 21) AS large_small_ratio,
    coalesce(min(s) FILTER (peak), arg_max(s, p)) AS first_scale, count(*) FILTER (peak) AS n_peaks, max(p) AS top
  FROM shares GROUP BY curve_id),
wfeat AS (SELECT *, CASE WHEN up > low THEN up - low ELSE span END AS scale_bandwidth FROM wf)"""


def _wavelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.wavelet_features(spectrum.height_function(event_curves(spark, sf_dir), spectrum.POINTS))


@query(f"WITH {_CWT} SELECT curve_id, {sql.rounded(' '.join(spectrum.WAVELET))}, round(domain_scale, 6) AS domain_scale, CAST(NULL AS VARCHAR) AS error FROM wfeat")
def wavelet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_wavelets(spark, sf_dir).drop("energy_distribution", "dominant_scales"))


@query(f"WITH {_CWT} SELECT curve_id, CAST(k AS INTEGER) AS scale_idx, round(p, 6) + 0.0 AS energy FROM shares")
def cwt_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each scale in a curve's energy."""
    e = _wavelets(spark, sf_dir).select("curve_id", F.posexplode("energy_distribution").alias("scale_idx", "energy"))
    return rounded(e)


@query(
    f"""WITH {_CWT} SELECT curve_id, round(greatest(0.001e0 * domain_scale, least(0.3e0 * domain_scale, 2 * first_scale)), 6) AS initial_delta,
  round(CASE WHEN large_small_ratio > 3 THEN 1.8e0 WHEN large_small_ratio > 1.5e0 THEN 1.6e0 WHEN large_small_ratio > 0.7e0 THEN 1.4e0 WHEN large_small_ratio > 0.3e0 THEN 1.3e0 ELSE 1.2e0 END
    * CASE WHEN energy_concentration > 0.8e0 THEN 0.9e0 WHEN energy_concentration < 0.3e0 THEN 1.1e0 ELSE 1e0 END, 6) AS delta_factor,
  CAST(greatest(8e0, least(30e0, floor(12 * (CASE WHEN wavelet_entropy > 3 THEN 1.4e0 WHEN wavelet_entropy > 2 THEN 1.2e0 WHEN wavelet_entropy > 1 THEN 1e0 ELSE 0.8e0 END
    * CASE WHEN multiscale_complexity > 0.2e0 THEN 1.3e0 WHEN multiscale_complexity > 0.1e0 THEN 1.1e0 ELSE 0.9e0 END * CASE WHEN scale_bandwidth / domain_scale > 0.5e0 THEN 1.2e0 WHEN scale_bandwidth / domain_scale > 0.2e0 THEN 1e0 ELSE 0.8e0 END)))) AS INTEGER) AS num_steps,
  round(CASE WHEN n_peaks > 3 THEN 0.8e0 ELSE 1e0 END * CASE WHEN top > 0.9e0 THEN 0.7e0 WHEN top < 0.1e0 THEN 0.8e0 ELSE 1e0 END * CASE WHEN wavelet_entropy < 0.5e0 OR wavelet_entropy > 5 THEN 0.8e0 ELSE 1e0 END, 6) AS confidence FROM wfeat"""
)
def wavelet_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.wavelet_parameters(_wavelets(spark, sf_dir))
    return rounded(out.select("curve_id", "initial_delta", "delta_factor", "num_steps", "confidence"))


@query(
    f"""WITH {_CWT}, line AS (SELECT curve_id, count(*) FILTER (p > 0) AS k, regr_slope(log10(p), -2 + 2 * k / 31e0) FILTER (p > 0) AS exponent, regr_r2(log10(p), -2 + 2 * k / 31e0) FILTER (p > 0) AS r_squared FROM shares GROUP BY curve_id)
SELECT curve_id, round(exponent, 6) + 0.0 AS exponent, round(r_squared, 6) + 0.0 AS r_squared,
  CASE WHEN k < 3 THEN 'insufficient_data' WHEN r_squared <= 0.8e0 THEN 'non_fractal' WHEN exponent > -2 AND exponent < 0 THEN 'strong_fractal' WHEN exponent > -3 AND exponent < -2 THEN 'moderate_fractal' ELSE 'weak_fractal' END AS scaling_class FROM line"""
)
def wavelet_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectrum.wavelet_scaling(_wavelets(spark, sf_dir)))


@query()
def comprehensive_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comprehensive.analyse(event_curves(spark, sf_dir)))
