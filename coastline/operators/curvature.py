"""Curvature along curves: finite differences, three points and circle fits, all as windows.

No window looks more than a few places around, so each runs over chunks of a curve
with a halo: a curve that holds a third of all points is as many groups as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from coastline.operators import quantiles, spread
from coastline.operators.curves import endpoints

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def unique_points(segs: DataFrame, ranged: bool = False) -> DataFrame:
    """(curve_id, pos, x, y): each point once, by x and then by first appearance; ``ranged``: numbered by ranges, over all tasks."""
    first = endpoints(segs).groupBy("curve_id", "x", "y").agg(F.min("pos").alias("first"))
    if ranged:
        return spread.numbered(first, "curve_id", ["x", "first"]).select("curve_id", (F.col("pos") + 1).alias("pos"), "x", "y")
    w = Window.partitionBy("curve_id").orderBy("x", "first")
    return first.select("curve_id", F.row_number().over(w).cast("bigint").alias("pos"), "x", "y")


def _gradient(df: DataFrame, column: str, out: str, w: WindowSpec) -> DataFrame:
    """Central differences, one-sided at the ends."""
    c, before, after = F.col(column), F.lag(column).over(w), F.lead(column).over(w)
    return df.withColumn(out, F.when(before.isNull(), after - c).when(after.isNull(), c - before).otherwise((after - before) / 2))


def _sized(points: DataFrame) -> DataFrame:
    """Curves of three points or more, with n."""
    return spread.with_totals(points, "curve_id", n=F.count(F.lit(1))).where("n >= 3")


def finite_difference(points: DataFrame) -> DataFrame:
    """(curve_id, pos, n, curvature)."""

    def kernel(df: DataFrame, w: WindowSpec) -> DataFrame:
        for source, out in (("x", "dx"), ("y", "dy"), ("dx", "ddx"), ("dy", "ddy")):
            df = _gradient(df, source, out, w)
        return df

    df = spread.in_chunks(_sized(points), "curve_id", "pos", 2, 2, kernel)
    return df.select("curve_id", "pos", "n", F.expr("abs(dx * ddy - dy * ddx) / greatest(pow(dx * dx + dy * dy, 1.5D), 1e-10D)").alias("curvature"))


def three_point(points: DataFrame) -> DataFrame:
    """Four times the triangle's area over the product of its sides; the ends copy their neighbours."""

    def kernel(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w), "x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
        df = df.withColumns(
            {
                "area": F.expr("0.5D * abs((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0))"),
                "a": F.expr("sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0))"),
                "b": F.expr("sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))"),
                "c": F.expr("sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0))"),
            }
        )
        df = df.withColumn("k", F.expr("case when x0 is null or x2 is null then null when a > 0 and b > 0 and c > 0 then 4 * area / (a * b * c) else 0D end"))
        return df.withColumn("curvature", F.when(F.col("x0").isNull(), F.lead("k").over(w)).when(F.col("x2").isNull(), F.lag("k").over(w)).otherwise(F.col("k")))

    return spread.in_chunks(_sized(points), "curve_id", "pos", 2, 2, kernel).select("curve_id", "pos", "n", "curvature")


def circle_fit(points: DataFrame, window: int = 5) -> DataFrame:
    """1 / radius of the least-squares circle through the points around each one; 0 where they lie on a line.

    With coordinates from the window's mean the normal equations are two, which
    are solved in closed form from sums over the frame's at most ``window`` points.
    """
    reach = window // 2
    near = lambda df, w: df.withColumn("p", F.collect_list(F.struct("x", "y")).over(w.rowsBetween(-reach, reach)))
    df = spread.in_chunks(_sized(points), "curve_id", "pos", reach, reach, near)
    df = df.withColumns({"mx": F.expr("aggregate(p, 0D, (a, q) -> a + q.x) / size(p)"), "my": F.expr("aggregate(p, 0D, (a, q) -> a + q.y) / size(p)")})
    df = df.withColumn("p", F.expr("transform(p, q -> struct(q.x - mx as u, q.y - my as v))"))
    total = lambda e: F.expr(f"aggregate(p, 0D, (a, q) -> a + {e})")
    df = df.withColumns({"uu": total("q.u * q.u"), "vv": total("q.v * q.v"), "uv": total("q.u * q.v"), "ru": total("q.u * (q.u * q.u + q.v * q.v) / 2"), "rv": total("q.v * (q.u * q.u + q.v * q.v) / 2")})
    df = df.withColumn("det", F.expr("uu * vv - uv * uv"))
    df = df.withColumns({"a": F.expr("(ru * vv - rv * uv) / nullif(det, 0D)"), "b": F.expr("(rv * uu - ru * uv) / nullif(det, 0D)")})
    radius = "sqrt(a * a + b * b + (uu + vv) / size(p))"
    return df.select("curve_id", "pos", "n", F.expr(f"case when size(p) >= 3 and det > 1e-14D * (uu + vv) * (uu + vv) and {radius} > 1e-10D then 1 / {radius} else 0D end").alias("curvature"))


METHODS = {"finite_difference": finite_difference, "three_point": three_point, "fit_circle": circle_fit}


def features(segs: DataFrame, method: str = "finite_difference", ranged: bool = False) -> DataFrame:
    """Moments, percentiles and local variation of each curve's curvature; ``ranged``: points and percentiles by ranges, over all tasks.

    The rolling deviation takes complete windows of min(5, n // 3) points; the
    window's width is one of four, so each has a frame of its own.
    """
    k = METHODS[method](unique_points(segs, ranged)).where("curvature is not null and not isnan(curvature) and abs(curvature) < double('Infinity')")
    k = spread.with_totals(k, "curve_id", m=F.count(F.lit(1)))

    def rolling(df: DataFrame, order: WindowSpec) -> DataFrame:
        local = F.lit(None).cast("double")
        for w in (2, 3, 4, 5):
            frame = order.rowsBetween(0, w - 1)
            local = F.when((F.least(F.lit(5), F.floor(F.col("m") / 3)) == w) & (F.count(F.lit(1)).over(frame) == w), F.stddev_pop("curvature").over(frame)).otherwise(local)
        return df.withColumn("local", local)

    k = spread.in_chunks(k, "curve_id", "pos", 0, 4, rolling)
    if ranged:
        found = quantiles.exact(k, "curve_id", "curvature", [p / 100 for p in (25, 75, *PERCENTILES)])
        marks = spread.written(found.select("curve_id", F.slice("quantiles", 1, 2).alias("q"), F.slice("quantiles", 3, len(PERCENTILES)).alias("p")))
        percentiles = F.any_value("p")
    else:
        marks = k.groupBy("curve_id").agg(F.expr("percentile(curvature, array(0.25D, 0.75D))").alias("q"))
        percentiles = F.expr(f"percentile(curvature, array({', '.join(f'{p / 100}D' for p in PERCENTILES)}))")
    k = k.join(marks, "curve_id")
    c = F.col("curvature")
    out = k.groupBy("curve_id").agg(
        F.avg(c).alias("mean_curvature"), F.var_pop(c).alias("curvature_variance"), F.max(c).alias("max_curvature"), (F.max(c) - F.min(c)).alias("curvature_range"),
        (F.count(F.when(c > F.col("q")[1], 1)) / F.count(F.lit(1))).alias("high_curvature_fraction"), F.skewness(c).alias("curvature_skewness"),
        F.when(F.count(F.lit(1)) > 3, F.kurtosis(c)).alias("curvature_kurtosis"), percentiles.alias("curvature_percentiles"),
        F.when(F.max("m") > 5, F.avg("local")).otherwise(F.var_pop(c)).alias("local_complexity_variation"), (F.count(F.when(c < F.col("q")[0], 1)) / F.count(F.lit(1))).alias("smooth_region_fraction"),
    )
    return out


def parameters(df: DataFrame) -> DataFrame:
    """curve_id, features and domain_scale -> initial_delta, delta_factor, num_steps."""
    d = {
        "k": "coalesce(nanvl(mean_curvature, null), 1 / domain_scale)", "v": "coalesce(nanvl(curvature_variance, null), 0.1D)", "mx": "coalesce(nanvl(max_curvature, null), 2 / domain_scale)",
        "hi": "coalesce(nanvl(high_curvature_fraction, null), 0.25D)", "sm": "coalesce(nanvl(smooth_region_fraction, null), 0.5D)", "lv": "coalesce(nanvl(local_complexity_variation, null), 0.1D)",
    }
    df = df.withColumns({f"_{k}": F.expr(v) for k, v in d.items()})
    delta = "case when _k > 0 then 0.5D / _k * case when _sm > 0.7 then 2D when _sm < 0.3 then 0.5D else 1D end else 0.05D * domain_scale end"
    base = "case when _mx > 0 and _k > 0 then case when _mx / _k > 10 then 1.3D when _mx / _k > 5 then 1.4D when _mx / _k > 2 then 1.5D else 1.7D end else 1.5D end"
    factor = f"({base}) * case when _hi > 0.5 then 0.9D when _hi < 0.2 then 1.1D else 1D end * case when _lv > 0.5D * _v then 0.95D else 1D end"
    steps = "12 * case when _v > _k * _k then 1.4D when _v > 0.5D * _k * _k then 1.2D else 1D end * case when _hi > 0.4 then 1.3D when _hi > 0.2 then 1.1D else 0.9D end * case when _lv > _v then 1.2D else 1D end"
    out = df.withColumns(
        {
            "initial_delta": F.expr(f"greatest(0.001D * domain_scale, least(0.2D * domain_scale, {delta}))"),
            "delta_factor": F.expr(f"greatest(1.1D, least(2D, {factor}))"),
            "num_steps": F.expr(f"cast(greatest(8D, least(25D, floor({steps} + 1e-9D))) as int)"),
        }
    )
    return out.drop(*[f"_{k}" for k in d])


def finite(name: str) -> str:
    return f"({name} is not null and not isnan({name}) and abs({name}) < double('Infinity'))"


def confidence(df: DataFrame) -> DataFrame:
    """0..1: missing features, the ratio of largest to mean curvature, and the fractions' sum count against it."""
    names = ("mean_curvature", "curvature_variance", "max_curvature", "high_curvature_fraction", "smooth_region_fraction", "local_complexity_variation")
    missing = " + ".join(f"cast(not {finite(n)} as int)" for n in names)
    ratio = "case when mean_curvature > 0 then case when max_curvature / mean_curvature between 1 and 100 then 1D when max_curvature / mean_curvature > 1000 then 0.6D else 0.8D end else 1D end"
    sum_ok = "case when high_curvature_fraction + smooth_region_fraction between 0.3D and 1D then 1D else 0.8D end"
    return df.withColumn("confidence", F.expr(f"greatest(0D, least(1D, (1 - 0.15D * ({missing})) * {ratio} * {sum_ok} * case when coalesce(size(curvature_percentiles), 0) < 5 then 0.7D else 1D end))"))


def complexity(df: DataFrame) -> DataFrame:
    """Class by mean curvature, kind of distribution by skewness, uniformity and sizes for box counting."""
    k, s = F.col("mean_curvature"), F.col("curvature_skewness")
    by_mean = F.when(k < 0.1, "very_smooth").when(k < 1, "smooth").when(k < 10, "moderate_complexity").when(k < 100, "high_complexity").otherwise("very_high_complexity")
    by_skew = F.when(s > 2, "highly_skewed_right").when(s > 0.5, "skewed_right").when(s > -0.5, "symmetric").when(s > -2, "skewed_left").otherwise("highly_skewed_left")
    smooth = F.col("smooth_region_fraction")
    return df.withColumns(
        {
            "complexity_class": F.when(F.expr(finite("mean_curvature")), by_mean).otherwise("unknown"),
            "distribution_type": F.when(F.expr(finite("curvature_skewness")), by_skew).otherwise("unknown"),
            "uniformity": 1 / (1 + F.col("curvature_variance")),
            "min_box_size": F.when(k > 0, F.least(0.1 / F.nullif(k, F.lit(0.0)), F.lit(1.0))).otherwise(0.01),
            "max_box_size": F.when(k > 0, F.least(1 / F.nullif(k, F.lit(0.0)), F.lit(10.0))).otherwise(1.0),
            "smoothness": F.when(smooth > 0.6, "smooth").when(smooth < 0.3, "complex").otherwise("mixed"),
        }
    )
