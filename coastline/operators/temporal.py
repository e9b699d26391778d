"""Series of frames: parameters carried from frame to frame, summaries, differences, file discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START_FACTOR, START_STEPS, FAST_STEPS = 1.4, 15, 20


def recurrence(frames: DataFrame) -> DataFrame:
    """(series_id, time, n_segments, domain_scale) -> with initial_delta, delta_factor, num_steps.

    What a frame gets depends on its place and on how the counts of the two
    frames before it changed: the size shrinks by a factor of its own for each
    kind of change, the ladder's factor grows with every fast one up to 2, and
    the steps add up, where a fast change also caps them at 20. Written out, the
    first is a product of powers of three numbers of frames so far, and the steps
    are a running sum plus a running least of what the caps leave: windows over
    each series, which keep nothing but the last row. A count of zero makes the
    change unknown, which counts as a moderate one.
    """
    order = Window.partitionBy("series_id").orderBy("time")
    df = frames.withColumns({"k": F.row_number().over(order), "n1": F.lag("n_segments", 1).over(order), "n2": F.lag("n_segments", 2).over(order), "scale": F.first("domain_scale").over(order)})
    change = (F.col("n1") - F.col("n2")) / F.nullif(F.col("n2").cast("double"), F.lit(0.0))
    df = df.withColumn("kind", F.when(F.col("k") == 1, "first").when(F.col("k") == 2, "second").when(change > 0.5, "fast").when(change < 0.1, "slow").otherwise("moderate"))
    so_far = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(order)
    df = df.withColumns({"fast": so_far("fast"), "second": so_far("second"), "moderate": so_far("moderate")})
    df = df.withColumn("added", 2 * F.col("fast") + F.col("moderate"))
    df = df.withColumn("cap", F.min(F.when(F.col("kind") == "fast", FAST_STEPS - F.col("added"))).over(order))
    delta = F.col("scale") / 200 * F.pow(F.lit(0.95), "second") * F.pow(F.lit(0.8), "fast") * F.pow(F.lit(0.9), "moderate")
    steps = F.col("added") + F.least(F.lit(START_STEPS), F.coalesce("cap", F.lit(START_STEPS)))
    factor = F.least(START_FACTOR + 0.1 * F.col("fast"), F.lit(2.0))
    return df.select("series_id", "time", F.col("n_segments").cast("bigint").alias("n_segments"), delta.alias("initial_delta"), factor.alias("delta_factor"), steps.cast("int").alias("num_steps"))


def summary(evolution: DataFrame) -> DataFrame:
    """Per series: range of time and dimension, frames, frames with a dimension, first and last size, growth."""
    d = F.nanvl(F.col("dimension"), F.lit(None).cast("double"))
    out = evolution.groupBy("series_id").agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min(d).alias("min_dimension"), F.max(d).alias("max_dimension"), F.count(F.lit(1)).alias("n_frames"), F.count(d).alias("n_success"),
        F.min_by("n_segments", "time").alias("initial_segments"), F.max_by("n_segments", "time").alias("final_segments"),
    )
    return out.withColumn("growth_factor", F.when(F.col("initial_segments") > 0, F.col("final_segments") / F.col("initial_segments")))


def deltas(evolution: DataFrame) -> DataFrame:
    """Change of dimension and time from frame to frame."""
    w = Window.partitionBy("series_id").orderBy("time")
    out = evolution.withColumns({"d_time": F.col("time") - F.lag("time").over(w), "d_dimension": F.col("dimension") - F.lag("dimension").over(w)})
    return out.where("d_time is not null").select("series_id", "time", "d_time", "d_dimension")


def wanted_stamps(spark: SparkSession, start: float, end: float, step: float) -> DataFrame:
    """Times of a range and the millisecond stamps of their files."""
    n = int((end - start) / step + 1e-9)
    return spark.range(n + 1).select(F.col("id").alias("k"), (F.lit(start) + F.col("id") * step).alias("time")).withColumn("stamp", F.floor(F.round(F.col("time") * 1000, 6)).cast("bigint"))


def discover(wanted: DataFrame, files: DataFrame, pattern: str = r"-(\d+)\.vtk$") -> DataFrame:
    """(k, time, stamp) against (path): the path of each wanted frame, null where it is missing."""
    found = files.select("path", F.regexp_extract("path", pattern, 1).alias("s")).where("s != ''").groupBy(F.col("s").cast("bigint").alias("stamp")).agg(F.min("path").alias("path"))
    return wanted.join(found, "stamp", "left").select("k", "time", "stamp", "path")
