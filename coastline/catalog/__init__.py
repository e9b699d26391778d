"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("curve_queries", "feedback_queries", "signal_queries", "spectrum_queries", "generator_queries", "study_queries", "comparison_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(f"coastline.catalog.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in import_module(f"coastline.catalog.{m}").ORACLES.items()}
