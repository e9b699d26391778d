"""Self-similarity of signals: structure functions, Hurst exponents, scaling ranges, and what follows from them.

A signal table has series_id, idx (from 0, without gaps) and value. The three
estimates of the Hurst exponent explode a signal once per lag or block size (at
most 50), group, and fit a line per signal; all are plain aggregations. What looks
along a signal goes by chunks of it: lags see the first values of the next chunk, and
running sums carry the sums of the chunks before, so that a long signal is
spread over as many tasks as it has chunks. The best scaling window is found among at
most 5,000 windows a signal, by prefix moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastline.operators import spread

MAX_LAG = 50


def _counted(signal: DataFrame) -> DataFrame:
    """With n, the points of the signal."""
    return signal if "n" in signal.columns else spread.with_totals(signal, "series_id", n=F.count(F.lit(1)))


def standardised(signal: DataFrame) -> DataFrame:
    """Mean removed; divided by the population deviation where that is positive. Adds n."""
    out = spread.with_totals(signal.select("series_id", "idx", "value"), "series_id", _m=F.avg("value"), _s=F.stddev_pop("value"), n=F.count(F.lit(1)))
    return out.select("series_id", "idx", "n", ((F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("value"))


def _limit(share: int, most: int) -> Column:
    return F.least(F.floor(F.col("n") / share), F.lit(most))


def structure_function(signal: DataFrame, share: int = 4, most: int = MAX_LAG, order: float = 2.0) -> DataFrame:
    """(series_id, lag) -> mean of |x(t + lag) - x(t)| ** order, for lags up to n // share and at most ``most``.

    A chunk of a signal is one array with ``most`` values of the next one, so the
    lags need no join; its sums over each lag are added up.
    """
    rows = spread.haloed(_counted(signal), "idx", 0, most)
    lists = rows.groupBy("series_id", "chunk", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("x"), F.count_if("own").alias("own"))
    lists = lists.withColumn("lag", F.explode(F.expr(f"sequence(1, greatest(1, cast(least(n div {share}, {most}) as int)))"))).where("n > lag")
    lists = lists.withColumn("m", F.greatest(F.lit(0), F.least(F.col("own"), F.size("x") - F.col("lag"))).cast("int"))
    pairs = F.zip_with(F.slice("x", F.lit(1), F.col("m")), F.slice("x", F.col("lag") + 1, F.col("m")), lambda a, b: F.pow(F.abs(b - a), F.lit(float(order))))
    sums = lists.withColumn("t", F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)).groupBy("series_id", "n", "lag").agg((F.sum("t") / F.sum("m")).alias("value"))
    return sums.select("series_id", "n", F.col("lag").cast("bigint").alias("lag"), "value")


def _fit(points: DataFrame, x: str, name: str, slope: str) -> DataFrame:
    """Line through log10 of the positive values over log10 of x, per signal with three points or more."""
    ok = points.where("value > 0 and value < double('Infinity') and not isnan(value)")
    fit = ok.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"), F.expr(f"regr_slope(log10(value), log10({x}))").alias("s"), F.expr(f"regr_r2(log10(value), log10({x}))").alias(f"r2_{name}"))
    return fit.where("_n >= 3").select("series_id", F.expr(slope).alias(f"hurst_{name}"), f"r2_{name}")


def hurst_sf(signal: DataFrame) -> DataFrame:
    return _fit(structure_function(signal), "lag", "sf", "s / 2")


def _blocks(signal: DataFrame, first: int, last: Column) -> DataFrame:
    """Each row once per block size b from ``first`` to ``last``, with its block; incomplete blocks are left out."""
    out = signal.withColumn("_b1", last.cast("int")).where(F.col("_b1") >= first)
    out = out.withColumn("b", F.explode(F.sequence(F.lit(first), F.col("_b1")))).withColumn("block", F.expr("idx div b"))
    return out.where("block < n div b")


def hurst_va(signal: DataFrame) -> DataFrame:
    """From how the variance of block means falls with the block size."""
    rows = _blocks(_counted(signal), 2, F.least(_limit(4, MAX_LAG), F.floor(F.col("n") / 2) - 1))
    means = rows.groupBy("series_id", "b", "block").agg(F.avg("value").alias("m"))
    return _fit(means.groupBy("series_id", "b").agg(F.var_pop("m").alias("value")), "b", "va", "(s + 2) / 2")


def _dfa(centred: DataFrame) -> DataFrame:
    n = spread.running_sums(centred, "series_id", "idx", {"y": F.col("value")})
    rows = _blocks(n, 4, F.least(_limit(4, MAX_LAG), F.floor(F.col("n") / 4) - 1))
    rest = rows.groupBy("series_id", "b", "block").agg(F.expr("regr_syy(y, idx) - regr_sxy(y, idx) * regr_sxy(y, idx) / regr_sxx(y, idx)").alias("ss"))
    about = rest.withColumn("rms", F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("b"))))
    return _fit(about.groupBy("series_id", "b").agg(F.avg("rms").alias("value")), "b", "dfa", "s")


def hurst_dfa(signal: DataFrame) -> DataFrame:
    """From how the spread about straight lines in blocks of the running sum grows with the block size."""
    n = spread.with_totals(signal.select("series_id", "idx", "value"), "series_id", n=F.count(F.lit(1)), _m=F.avg("value"))
    return _dfa(n.select("series_id", "idx", "n", (F.col("value") - F.col("_m")).alias("value")))


def hurst(signal: DataFrame) -> DataFrame:
    """The three estimates of each standardised signal, their mean weighted by fit, and the confidence 1 / estimates.

    Each estimate, one row a signal, is written, so that no task makes all three at once.
    """
    z = standardised(signal)
    out = signal.select("series_id").distinct()
    for estimate in (hurst_sf(z), hurst_va(z), _dfa(z)):
        out = out.join(spread.written(estimate), "series_id", "left")
    w = lambda k: F.coalesce(F.col(f"r2_{k}"), F.lit(0.0))
    total = w("sf") + w("va") + w("dfa")
    mean = sum((F.coalesce(F.col(f"hurst_{k}"), F.lit(0.0)) * w(k) for k in ("va", "dfa")), F.coalesce(F.col("hurst_sf"), F.lit(0.0)) * w("sf")) / F.when(total > 0, total)
    n = sum((F.col(f"r2_{k}").isNotNull().cast("int") for k in ("va", "dfa")), F.col("r2_sf").isNotNull().cast("int"))
    return out.withColumns({"hurst_consensus": mean, "n_estimates": n, "hurst_confidence": F.when(n > 0, 1.0 / F.when(n > 0, n)).otherwise(0.0), "mean_r2": F.when(n > 0, total / F.when(n > 0, n))})


def block_variance(signal: DataFrame, share: int = 3, most: int = 100) -> DataFrame:
    """(series_id, lag) -> mean variance of windows of ``lag`` points: the other statistic for scaling ranges."""
    rows = _blocks(_counted(signal), 2, _limit(share, most)).where("block * b < n - b")
    per = rows.groupBy("series_id", "n", "b", "block").agg(F.var_pop("value").alias("v"))
    return per.groupBy("series_id", "n", F.col("b").cast("bigint").alias("lag")).agg(F.avg("v").alias("value"))


def scaling_range(signal: DataFrame, method: str = "structure_function", least: int = 5) -> DataFrame:
    """Lags between which the statistic follows a power law best: the contiguous window, of 5 points or more, with the first largest r squared.

    The fit of a window is the difference of two rows of prefix moments, joined by
    where it starts and ends: at most 100 x 100 / 2 rows a signal. A signal
    without such a window gets NaN, and a quality of 0 where it has the points.
    """
    stat = structure_function(signal, 3, 100) if method == "structure_function" else block_variance(signal)
    stat = stat.where("n >= 20")
    w = Window.partitionBy("series_id").orderBy("lag")
    points = stat.where("value > 0 and value < double('Infinity') and not isnan(value)").select("series_id", "lag", F.log10("lag").alias("x"), F.log10("value").alias("y"))
    moments = {"sx": "x", "sy": "y", "sxx": "x * x", "syy": "y * y", "sxy": "x * y"}
    ends = points.withColumns({"i": F.row_number().over(w)} | {n: F.sum(F.expr(e)).over(w) for n, e in moments.items()})
    before = {f"{n}0": F.coalesce(F.lag(n).over(w), F.lit(0.0)) for n in moments}
    starts = ends.withColumns(before).select("series_id", F.col("i").alias("a"), F.col("lag").cast("double").alias("lo"), *before)
    both = ends.join(starts, "series_id").where(F.col("i") >= F.col("a") + (least - 1)).withColumn("k", F.col("i") - F.col("a") + 1)
    both = both.withColumns({n: F.col(n) - F.col(f"{n}0") for n in moments})
    both = both.withColumns({"cx": F.expr("sxx - sx * sx / k"), "cy": F.expr("syy - sy * sy / k"), "cxy": F.expr("sxy - sx * sy / k")})
    both = both.withColumn("r2", F.expr("case when cx > 0 and cy > 0 then cxy * cxy / (cx * cy) else 0D end"))
    first = F.min_by(F.struct("lo", F.col("lag").cast("double").alias("hi"), "r2"), F.struct(-F.col("r2"), "a", "i")).alias("b")
    best = both.groupBy("series_id").agg(first)
    none, found = F.lit(float("nan")), F.col("b.r2") > 0
    out = stat.select("series_id").distinct().join(best, "series_id", "left")
    return out.select("series_id", F.when(found, F.col("b.lo")).otherwise(none).alias("scaling_min"), F.when(found, F.col("b.hi")).otherwise(none).alias("scaling_max"), F.coalesce("b.r2", none).alias("scaling_quality"))


def character(df: DataFrame) -> DataFrame:
    """fractal_character, predicted_dimension and, with a scaling quality, self_similarity_strength."""
    h, c = F.col("hurst_consensus"), F.col("hurst_confidence")
    open_ = lambda lo, hi: (h > lo) & (h < hi)
    kind = F.when(open_(0.8, 1.2), "strong_fractal").when(open_(0.3, 0.7) | open_(1.2, 1.7), "moderate_fractal").when(open_(0.1, 0.9) | open_(1.1, 1.9), "weak_fractal").otherwise("non_fractal")
    return df.withColumns({"fractal_character": F.when(h.isNotNull() & (c > 0.7), kind).otherwise("uncertain"), "predicted_dimension": F.greatest(F.lit(1.0), F.least(F.lit(2.0), 2 - h))})


def properties(df: DataFrame) -> DataFrame:
    """Kind of fractal by the exponent, and how multifractal it is by the estimates' spread."""
    h = F.col("hurst_consensus")
    values = F.filter(F.array("hurst_sf", "hurst_va", "hurst_dfa"), lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    df = df.withColumns({"_v": values})
    df = df.withColumn("_m", F.when(F.size("_v") >= 2, mean)).withColumn("hurst_variation", F.expr("case when size(_v) >= 2 then sqrt(aggregate(_v, 0D, (a, v) -> a + (v - _m) * (v - _m)) / size(_v)) end"))
    s = F.col("hurst_variation")
    kind = F.when(h.isNull(), "unknown").when((h >= 0.95) & (h <= 1.05), "brownian_motion").when(h > 1.05, "persistent_fractal").otherwise("antipersistent_fractal")
    return df.withColumns({"fractal_type": kind, "multifractal_character": F.when(s.isNull(), "unknown").when(s < 0.05, "monofractal").when(s < 0.15, "weak_multifractal").otherwise("strong_multifractal")}).drop("_v", "_m")


def parameters(df: DataFrame) -> DataFrame:
    """hurst_consensus, hurst_confidence, scaling_min, scaling_max, scaling_quality, self_similarity_strength and domain_scale -> parameters."""
    df = df.withColumns(
        {
            "_h": F.expr("coalesce(hurst_consensus, 0.8D)"), "_lo": F.expr("coalesce(nanvl(scaling_min, null), 0.01D * domain_scale)"), "_hi": F.expr("coalesce(nanvl(scaling_max, null), 0.1D * domain_scale)"),
            "_q": F.expr("coalesce(nanvl(scaling_quality, null), 0.5D)"), "_t": F.expr("coalesce(nanvl(self_similarity_strength, null), 0.3D)"),
        }
    )
    delta = "case when _hi > _lo and _lo > 0 then 0.7D * sqrt(_lo * _hi) else domain_scale * case when _h > 0.8 then 0.02D when _h < 0.3 then 0.05D else 0.03D end end"
    factor = "1.5D * case when _h between 0.7 and 1.3 then 1.2D when _h between 0.5 and 1.5 then 1.1D else 0.9D end * case when _t > 0.5 then 1.2D when _t > 0.2 then 1.1D else 0.9D end * case when _q > 0.9 then 1.1D when _q > 0.7 then 1D else 0.95D end"
    decades = "case when _hi > _lo and _lo > 0 then case when log10(_hi / _lo) > 2 then 1.4D when log10(_hi / _lo) > 1 then 1.2D when log10(_hi / _lo) > 0.5 then 1D else 0.8D end else 1D end"
    steps = f"12 * {decades} * case when hurst_confidence > 0.8 then 1.2D when hurst_confidence > 0.6 then 1.1D else 0.9D end * case when _t > 0.4 then 1.1D else 1D end"
    return df.withColumns(
        {
            "initial_delta": F.expr(f"greatest(0.001D * domain_scale, least(0.2D * domain_scale, {delta}))"),
            "delta_factor": F.expr(f"greatest(1.1D, least(2D, {factor}))"),
            "num_steps": F.expr(f"cast(greatest(8D, least(30D, floor({steps} + 1e-9D))) as int)"),
        }
    ).drop("_h", "_lo", "_hi", "_q", "_t")


def row(signal: DataFrame) -> DataFrame:
    """Each signal's whole self-similarity: three exponents with their fits, consensus, scaling range, strength, character and kinds."""
    out = hurst(signal).join(spread.written(scaling_range(standardised(signal).drop("n"))), "series_id", "left")
    out = out.withColumn("self_similarity_strength", F.abs(F.col("hurst_consensus") - 0.5) * F.col("scaling_quality"))
    return properties(character(out))
