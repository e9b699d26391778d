"""Geometric features of curves, one row per curve, from one pass over the segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.operators.curves import endpoints, turns

TURN = 0.5235987755982988  # pi / 6
FEATURES = (
    "n_segments bbox_width bbox_height bbox_area characteristic_length min_segment_length max_segment_length mean_segment_length segment_length_std segment_length_cv angle_std angle_range"
    " direction_changes direction_change_rate tortuosity dimension_estimate total_length euclidean_length aspect_ratio linearity_r_squared complexity_score scale_ratio density"
).split()


def linearity(segs: DataFrame) -> DataFrame:
    """r squared of y over x at both ends of all segments: 1 if all x are equal, 0 if all y are."""
    p = endpoints(segs)
    return p.groupBy("curve_id").agg(F.expr("case when min(x) = max(x) then 1D when min(y) = max(y) then 0D else regr_r2(y, x) end").alias("linearity_r_squared"))


def features(segs: DataFrame) -> DataFrame:
    """The 23 features of each curve."""
    s = turns(segs)
    out = s.groupBy("curve_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.expr("max(greatest(x1, x2)) - min(least(x1, x2))").alias("bbox_width"),
        F.expr("max(greatest(y1, y2)) - min(least(y1, y2))").alias("bbox_height"),
        F.min("length").alias("min_segment_length"), F.max("length").alias("max_segment_length"), F.avg("length").alias("mean_segment_length"),
        F.stddev_pop("length").alias("segment_length_std"), F.sum("length").alias("total_length"),
        F.stddev_pop("angle").alias("angle_std"), (F.max("angle") - F.min("angle")).alias("angle_range"),
        F.count(F.when(F.col("turn") > TURN, 1)).alias("direction_changes"),
        F.min_by(F.struct("x1", "y1"), "seg_idx").alias("_first"), F.max_by(F.struct("x2", "y2"), "seg_idx").alias("_last"),
        # the regression of y on x over both ends of every segment, without making a row of each end
        F.expr("min(least(x1, x2)) = max(greatest(x1, x2))").alias("_same_x"), F.expr("min(least(y1, y2)) = max(greatest(y1, y2))").alias("_same_y"),
        F.sum(F.expr("x1 + x2")).alias("_x"), F.sum(F.expr("y1 + y2")).alias("_y"), F.sum(F.expr("x1 * x1 + x2 * x2")).alias("_xx"), F.sum(F.expr("y1 * y1 + y2 * y2")).alias("_yy"),
        F.sum(F.expr("x1 * y1 + x2 * y2")).alias("_xy"),
    )
    m = "2 * n_segments"
    r2 = f"pow(_xy - _x * _y / ({m}), 2) / ((_xx - _x * _x / ({m})) * (_yy - _y * _y / ({m})))"
    out = out.withColumn("linearity_r_squared", F.expr(f"case when _same_x then 1D when _same_y then 0D else least(1D, {r2}) end"))
    gap = F.expr("sqrt((_last.x2 - _first.x1) * (_last.x2 - _first.x1) + (_last.y2 - _first.y1) * (_last.y2 - _first.y1))")
    out = out.withColumn("euclidean_length", F.when(gap < 1e-6, F.col("bbox_width")).otherwise(gap))
    out = out.withColumn("tortuosity", F.col("total_length") / F.greatest("euclidean_length", F.lit(1e-6)))
    out = out.withColumns(
        {
            "bbox_area": F.expr("bbox_width * bbox_height"),
            "characteristic_length": F.expr("sqrt(bbox_width * bbox_height)"),
            "segment_length_cv": F.expr("case when mean_segment_length > 0 then segment_length_std / mean_segment_length else 0D end"),
            "direction_change_rate": F.expr("direction_changes / cast(n_segments as double)"),
            "dimension_estimate": F.expr("1 + least(ln(tortuosity) / ln(2D), 1D)"),
            "aspect_ratio": F.expr("bbox_height / greatest(bbox_width, 1e-10D)"),
            "scale_ratio": F.expr("max_segment_length / (min_segment_length + 1e-10D)"),
        }
    )
    out = out.withColumns({"complexity_score": F.expr("direction_change_rate * angle_std"), "density": F.expr("n_segments / (bbox_area + 1e-10D)")})
    return out.select("curve_id", *FEATURES)


def roughness(segs: DataFrame) -> DataFrame:
    return turns(segs).groupBy("curve_id").agg(
        F.stddev_pop("angle").alias("angle_std"), (F.max("angle") - F.min("angle")).alias("angle_range"), F.count(F.when(F.col("turn") > TURN, 1)).alias("direction_changes"),
        (F.count(F.when(F.col("turn") > TURN, 1)) / F.count(F.lit(1)).cast("double")).alias("direction_change_rate"),
    )


def turning(segs: DataFrame, level: int, turn: float = 0.7853981633974483) -> DataFrame:
    """Lengths, rate of turns over pi / 4, and the length against that of a curve of this level (2 ** (level / 2))."""
    out = turns(segs).groupBy("curve_id").agg(
        F.avg("length").alias("mean_length"), F.stddev_pop("length").alias("std_length"), F.sum("length").alias("total_length"), F.count(F.when(F.col("turn") > turn, 1)).alias("n_turns"),
        F.count(F.lit(1)).alias("n_segments"), F.expr("max(greatest(x1, x2)) - min(least(x1, x2))").alias("extent"),
    )
    out = out.withColumn("turn_rate", F.when(F.col("n_segments") > 1, F.col("n_turns") / (F.col("n_segments") - 1).cast("double")).otherwise(0.0))
    return out.withColumn("length_ratio", F.col("total_length") / F.lit(2.0 ** (level / 2.0)))
