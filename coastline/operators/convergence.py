"""Series of levels of one fractal: which levels are affordable, and how errors and times develop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coastline.operators import rules


def within_budget(levels: DataFrame, budget: DataFrame) -> DataFrame:
    """(fractal, level, n_segments) against (fractal, max_segments): the levels before the first that is too large."""
    own = levels.join(budget.select("fractal", "max_segments"), "fractal", "left")
    w = Window.partitionBy("fractal").orderBy("level")
    over = F.max((F.col("n_segments") > F.col("max_segments")).cast("int")).over(w)
    return own.withColumn("over", F.coalesce(over, F.lit(0))).where("over = 0").select("fractal", "level", "n_segments")


def status(levels: DataFrame) -> DataFrame:
    """(.., error_pct) -> with a word for the error."""
    return levels.withColumn("status", rules.tier(F.col("error_pct"), [(2, "excellent"), (5, "good"), (10, "moderate")], "poor"))


def report(levels: DataFrame) -> DataFrame:
    """(fractal, level, error_pct, seconds) -> per fractal, over the levels that have an error.

    The number of levels, the best one and its error; from three levels on by how
    much the last error is below the one two levels before, and whether that is an
    improvement; from two on how many times longer the last level took than the
    one before.
    """
    w = Window.partitionBy("fractal").orderBy("level")
    ok = levels.where("error_pct is not null and not isnan(error_pct)")
    ok = ok.withColumns({"gain": F.lag("error_pct", 2).over(w) - F.col("error_pct"), "ratio": F.col("seconds") / F.nullif(F.lag("seconds").over(w), F.lit(0.0)), "second": F.row_number().over(w) > 1})
    out = ok.groupBy("fractal").agg(
        F.count(F.lit(1)).alias("n_levels"), F.min_by("level", F.struct("error_pct", "level")).alias("best_level"), F.min("error_pct").alias("best_error"),
        F.max_by("gain", "level").alias("recent_gain"), F.max_by(F.when(F.col("second"), F.coalesce("ratio", F.lit(float("inf")))), "level").alias("time_ratio"),
    )
    return out.withColumn("trend", F.when(F.col("recent_gain") > 0, "improvement").when(F.col("recent_gain").isNotNull(), "plateau"))
