"""How much box counts depend on where the grid lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.operators import boxcount
from coastline.operators.rules import tier

#: Shares of a box by which the grid is shifted to the left and down.
OFFSETS = ((0.0, 0.0), (0.25, 0.0), (0.5, 0.0), (0.0, 0.25), (0.0, 0.5), (0.25, 0.25), (0.5, 0.5))


def counts_by_offset(segs: DataFrame, scales: DataFrame, offsets: Sequence[tuple[float, float]] = OFFSETS) -> DataFrame:
    """(curve, scale, offset) -> n_boxes; scales have the domain of their curve."""
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("offset_idx"), F.lit(float(a)).alias("ox"), F.lit(float(b)).alias("oy")) for i, (a, b) in enumerate(offsets)]))
    moved = scales.select("*", rows).withColumns({"xmin": F.col("xmin") - F.col("ox") * F.col("delta"), "ymin": F.col("ymin") - F.col("oy") * F.col("delta")})
    return boxcount.box_counts(segs, moved, ("curve_id",), ("k", "offset_idx"))


def spread(counts: DataFrame) -> DataFrame:
    """Least, largest and mean count over the offsets, range and deviation in percent of the mean, and a word for it."""
    out = counts.groupBy("curve_id", "k").agg(F.min("n_boxes").alias("min_boxes"), F.max("n_boxes").alias("max_boxes"), F.avg("n_boxes").alias("mean_boxes"), F.stddev_pop("n_boxes").alias("std_boxes"))
    out = out.withColumns({"range_pct": F.expr("(max_boxes - min_boxes) / mean_boxes * 100"), "cv_pct": F.expr("std_boxes / mean_boxes * 100")})
    return out.withColumn("sensitivity", tier(F.col("range_pct"), [(20, "high"), (10, "moderate"), (5, "low")], "minimal", above=True))


def half_shift(counts: DataFrame) -> DataFrame:
    """Count without an offset against the one with half a box in both directions, per scale."""
    at = lambda i: F.max(F.when(F.col("offset_idx") == i, F.col("n_boxes")))
    out = counts.groupBy("curve_id", "k").agg(at(0).alias("plain"), at(len(OFFSETS) - 1).alias("shifted"))
    return out.withColumn("change_pct", F.abs(F.col("shifted") - F.col("plain")) / F.col("plain") * 100)


#: Means of counts' changes that differ by less are one value.
TIE = 1e-9


def evidence(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(curve_id, base_id) and the changes of ``half_shift`` -> how far the curve's counts hang on the grid, and more than the base's.

    Changes of 100 percent or more are left out; a pair of which one curve has no
    other gives no row. Of three points one is for the mean change (over 10
    percent, half for over 5), one for its ratio to the base's (over 2, half for
    over 1.5; without end where the base's is 0), one for a change over 20 percent.
    """
    found = changes.where("change_pct < 100").groupBy("curve_id").agg(F.avg("change_pct").alias("mean_change"), F.max("change_pct").alias("max_change"))
    base = found.select(F.col("curve_id").alias("base_id"), F.col("mean_change").alias("base_change"))
    out = pairs.select("curve_id", "base_id").join(found, "curve_id").join(base, "base_id")
    out = out.withColumn("ratio", F.when(F.col("base_change") > 0, F.col("mean_change") / F.nullif("base_change", F.lit(0.0))).otherwise(float("inf")))
    over = lambda c, v: F.col(c) > v + TIE
    points = F.when(over("mean_change", 10), 1.0).when(over("mean_change", 5), 0.5).otherwise(0.0) + F.when(over("ratio", 2), 1.0).when(over("ratio", 1.5), 0.5).otherwise(0.0) + F.when(over("max_change", 20), 1.0).otherwise(0.0)
    out = out.withColumn("evidence", points)
    verdict = F.when(F.col("evidence") >= 2, "confirmed").when(F.col("evidence") >= 1, "partially confirmed").otherwise("not confirmed")
    return out.select("curve_id", "base_id", "mean_change", "max_change", "base_change", "ratio", "evidence", verdict.alias("verdict"))
