"""Curves of the driver's tables, and rounding that both engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.operators import curves


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.numbered_points(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events in the order of time."""
    return curves.segments_from_points(event_points(spark, sf_dir))


def order_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of each customer's orders in the order of their dates."""
    return curves.segments_from_points(curves.numbered_points(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without a negative zero: the whole number next to the multiple, as the SQL's round does, and not the decimal digits' half."""
    many = 10.0**digits
    return df.select(*[(F.when(F.abs(c) < 1e290, F.round(F.col(c) * many, 0) / many).otherwise(F.col(c)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
