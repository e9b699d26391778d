"""One way of measuring against another: errors of two groups, and of two sets of parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.operators import consensus, rules


def graded(df: DataFrame) -> DataFrame:
    """left_error and right_error in percent -> their ratio, what the right one gains on the left, and words for all three.

    The ratio is null without a right error or where it is 0; nothing is gained on a left error of 0.
    """
    gain = F.when(F.col("left_error") > 0, (F.col("left_error") - F.col("right_error")) / F.nullif("left_error", F.lit(0.0)) * 100).when(F.col("left_error").isNotNull() & F.col("right_error").isNotNull(), 0.0)
    df = df.withColumns({"error_ratio": F.col("left_error") / F.nullif("right_error", F.lit(0.0)), "improvement_pct": gain})
    grade = lambda c: F.when(F.col(c).isNotNull(), rules.wide_error_grade(F.col(c)))
    better = F.when(F.col("improvement_pct").isNotNull(), rules.improvement_grade(F.col("improvement_pct")))
    return df.withColumns({"left_grade": grade("left_error"), "right_grade": grade("right_error"), "improvement": better})


def errors_between(df: DataFrame, by: Sequence[str], column: str, left: str, right: str, error: str = "error_pct") -> DataFrame:
    """Mean error of the rows whose ``column`` is ``left`` against those where it is ``right``, per ``by``: one aggregation, no join."""
    mean = lambda v: F.avg(F.when(F.col(column) == v, F.col(error)))
    both = df.where(F.col(column).isin(left, right)).groupBy(*by)
    return graded(both.agg(F.count(error).alias("n"), mean(left).alias("left_error"), mean(right).alias("right_error")))


def parameters_between(left: DataFrame, right: DataFrame, actual: DataFrame) -> DataFrame:
    """Per curve: mean parameter error of two methods against parameters that served, what is right of each in percent, and which is nearer."""
    of = lambda df, name: consensus.parameter_error(df, actual).select("curve_id", F.col("error_pct").alias(name))
    both = of(left, "left_error").join(of(right, "right_error"), "curve_id")
    out = both.withColumns({"left_accuracy": 100 - F.col("left_error"), "right_accuracy": 100 - F.col("right_error"), "gain": F.col("left_error") - F.col("right_error")})
    return out.withColumn("nearer", F.when(F.col("gain") > 0, "right").when(F.col("gain") < 0, "left").otherwise("same"))
