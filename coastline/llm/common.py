"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``, as in tests) may leave it
    unset; it then gets a folder of this machine.
    """
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or os.path.join(tempfile.gettempdir(), "coastline-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the folder the cluster shares, which cuts its lineage.

    Unlike a checkpoint, the table read back carries no constraints of the plan
    behind it; those that a loop piles up take the optimizer ever longer. It is
    compressed, and read by column. The tables go when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/coastline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cut_told(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of its rows that are taken as they are written, so that no job of their own reads them again."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in facts.items()]))
    return out, seen.get


def fresh(n: int = 1) -> list[str]:
    """Names of columns that no caller's table has."""
    return [f"_{uuid.uuid4().hex}" for _ in range(n)]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the shared folder: for large tables outside loops, since it writes row by row and needs no buffers."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
