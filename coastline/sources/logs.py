"""JSON sources and sinks: the feedback log and saved runs of series."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.operators import temporal
from coastline.operators.features import FEATURES

FEEDBACK = (
    "timestamp string, interface_type string, features struct<" + ", ".join(f"{n}: double" for n in FEATURES) + ">, suggested_parameters struct<initial_delta: double, delta_factor: double, num_steps: double>,"
    " dimension_result double, theoretical_dimension double, accuracy_score double, r_squared double, computation_time double, success boolean, failure_mode string, implementation string"
)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The log's records; blank lines are skipped, a path without files is an empty log."""
    try:
        return spark.read.schema(FEEDBACK).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FEEDBACK)


def append_feedback(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def reset_feedback(records: DataFrame, path: str) -> None:
    """Replace the log by curated records."""
    records.write.mode("overwrite").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A saved run's detailed rows: time, n_segments, dimension, r_squared and the parameters."""
    df = spark.read.option("multiLine", True).json(path).select(F.explode("detailed_results").alias("r"))
    return df.select("r.time", "r.n_segments", "r.dimension", "r.r_squared", "r.parameters.*")


def run_json(evolution: DataFrame, **metadata: object) -> DataFrame:
    """(series_id, json): metadata, summary, parallel arrays and detailed rows of each series, in the order of time."""
    row = F.struct("time", F.struct("initial_delta", "delta_factor", "num_steps").alias("parameters"), "n_segments", "dimension", "r_squared")
    lists = evolution.groupBy("series_id").agg(F.array_sort(F.collect_list(row)).alias("detailed_results"))
    names = ("time", "n_segments", "dimension", "r_squared")
    arrays = F.struct(*[F.col(f"detailed_results.{n}").alias(n) for n in names], *[F.col(f"detailed_results.parameters.{p}").alias(p) for p in ("initial_delta", "delta_factor", "num_steps")])
    s = temporal.summary(evolution)
    growth = F.struct("initial_segments", "final_segments", "growth_factor").alias("complexity_evolution")
    summary = F.struct(F.array("first_time", "last_time").alias("time_range"), F.array("min_dimension", "max_dimension").alias("dimension_range"), F.col("n_frames").alias("total_timepoints"), F.col("n_success").alias("successful_analyses"), growth)
    about = F.struct(F.lit("temporal_evolution").alias("analysis_type"), *[F.lit(v).alias(k) for k, v in metadata.items()])
    both = lists.join(s.select("series_id", summary.alias("summary")), "series_id")
    return both.select("series_id", F.to_json(F.struct(about.alias("metadata"), "summary", arrays.alias("parameter_evolution"), "detailed_results")).alias("json"))
