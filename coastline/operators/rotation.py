"""Box counts of rotated curves: the least count over the angles, and the dimension from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.operators import boxcount, curves

ANGLES = tuple(float(a) for a in range(0, 91, 5))
DOMAIN = ("xmin", "xmax", "ymin", "ymax", "cx", "cy")


def counts_by_angle(segs: DataFrame, scales: DataFrame, angles: Sequence[float] = ANGLES) -> DataFrame:
    """(curve, scale, angle) -> n_boxes in the curve's expanded domain, turned about its centre.

    scales: curve_id, k, delta, and the domain with its centre (cx, cy) as ``default_scales`` has them, or without.
    """
    if "cx" not in scales.columns:
        scales = scales.join(curves.expanded(curves.bounding_boxes(segs), kept=["cx", "cy"]), "curve_id")
    return boxcount.box_counts(segs, scales, ("curve_id",), ("k",), angles=angles)


def least_counts(counts: DataFrame, angles: Sequence[float] = ANGLES) -> DataFrame:
    """(curve, scale) -> least count, its angle (the first that has it), the largest count, and the one at no rotation if there is one."""
    # a count and its angle as one number, which needs no sorting of rows
    n = len(angles)
    best = F.min(F.col("n_boxes") * n + F.col("angle_idx")).alias("_b")
    found = counts.groupBy("curve_id", "k", "delta").agg(best, F.max("n_boxes").alias("max_boxes"), F.max(F.when(F.col("rotation") == 0, F.col("n_boxes"))).alias("plain_boxes"))
    angle = F.element_at(F.array(*[F.lit(float(a)) for a in angles]), (F.col("_b") % n + 1).cast("int"))
    return found.select("curve_id", "k", "delta", F.expr(f"_b div {n}").alias("n_boxes"), angle.alias("best_angle"), "max_boxes", "plain_boxes")


def default_scales(segs: DataFrame, coarse: float = 5.0, fine: float = 100.0, factor: float = 1.5) -> DataFrame:
    """Sizes from the domain's larger side over ``coarse`` down to it over ``fine``: curve_id, k, delta, and the expanded domain with its centre."""
    steps = 1
    while coarse * factor**steps <= fine * (1 + 1e-12):
        steps += 1
    side = curves.expanded(curves.bounding_boxes(segs).withColumn("side", F.greatest("width", "height")).where("side > 0"), kept=["side", "cx", "cy"])
    params = side.select("curve_id", *DOMAIN, (F.col("side") / coarse).alias("initial_delta"), F.lit(factor).alias("delta_factor"), F.lit(steps).alias("num_steps"))
    return boxcount.ladder(params).select("curve_id", "k", "delta", *DOMAIN)


def rotation_dimension(segs: DataFrame, angles: Sequence[float] = ANGLES, **scales) -> DataFrame:
    """Dimension from the least counts over the angles: curve_id, dimension, r_squared, n_scales."""
    best = least_counts(counts_by_angle(segs, default_scales(segs, **scales), angles), angles)
    fit = boxcount.regression(best, ["curve_id"])
    return fit.where("n_scales >= 3").select("curve_id", F.col("slope").alias("dimension"), F.col("r2").alias("r_squared"), "n_scales")


def compare(segs: DataFrame, angles: Sequence[float] = ANGLES, **scales) -> DataFrame:
    """Dimension at no rotation against the one of the least counts."""
    best = least_counts(counts_by_angle(segs, default_scales(segs, **scales), angles), angles).withColumn("_x", F.log(F.lit(1.0) / F.col("delta")))
    # both from one pass over the counts; a scale without a count has no part in a slope
    slopes = {name: F.regr_slope(F.log(F.col(n).cast("double")), "_x").alias(name) for name, n in (("standard_dimension", "plain_boxes"), ("rotation_dimension", "n_boxes"))}
    out = best.groupBy("curve_id").agg(*slopes.values(), F.count("plain_boxes").alias("_n")).where("_n > 0").drop("_n")
    return out.withColumn("change", F.col("rotation_dimension") - F.col("standard_dimension"))


def by_angle(segs: DataFrame, scales: DataFrame, angles: Sequence[float] = ANGLES) -> DataFrame:
    """Spread of the dimension over the angles: n_angles, least, largest, mean, deviation, and the angle of the least."""
    return over_angles(counts_by_angle(segs, scales, angles))


def over_angles(counts: DataFrame) -> DataFrame:
    """The spread over the angles of each curve's counts; of angles whose dimensions differ by rounding only the first counts as the least."""
    fit = boxcount.regression(counts, ["curve_id", "angle_idx", "rotation"])
    # the order in which rows are added up decides about the last digits
    return fit.groupBy("curve_id").agg(
        F.count(F.lit(1)).alias("n_angles"), F.min("slope").alias("min_dimension"), F.max("slope").alias("max_dimension"), F.avg("slope").alias("mean_dimension"), F.stddev_pop("slope").alias("std_dimension"),
        F.min_by("rotation", F.struct(F.round("slope", 9), "angle_idx")).alias("min_angle"),
    )
