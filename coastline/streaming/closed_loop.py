"""The feedback log as a stream's sink: each micro-batch is written exactly once, curated records replace measured ones by key.

A log is a folder of Parquet with one folder for each batch. A batch that is run
again after a failure overwrites its own folder, so that neither a crash between
writing and committing nor a restart doubles or loses a record. Curated records are
versions beside the batches; reading takes of each key the newest version, or else
the newest measured record. Nothing is rewritten when a record is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coastline.operators import feedback, spread

BATCH, VERSION = "batch_id", "curated_version"


def _folder(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}/{BATCH if kind == 'measured' else VERSION}={number}"


def sink(stream: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame, int], DataFrame] = lambda df, batch: feedback.with_outcome(df), **trigger: object) -> StreamingQuery:
    """Start a query that scores each micro-batch and writes it to the log at ``path``.

    ``score`` gets the batch and its number. What it reads from the log has to be of
    earlier batches (``read(..., before=number)``), so that a batch run again gives
    the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        score(batch, number).write.mode("overwrite").parquet(_folder(path, "measured", number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def inject(curated: DataFrame, path: str, version: int) -> None:
    """Curated records as version ``version`` of their keys; the same version again replaces that version."""
    curated.write.mode("overwrite").parquet(_folder(path, "curated", version))


def _part(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{path}/{kind}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    """The log's records, one a key, with the batch or the version that they are from; None where nothing is written.

    Rows without a key are no versions of one another: all stay. Of a key's rows in
    one batch that with the greatest values, column by column, stays.
    """
    measured, curated = _part(spark, path, "measured"), _part(spark, path, "curated")
    if measured is not None and before is not None:
        measured = measured.where(F.col(BATCH) < before)
    parts = [df for df in (measured, curated) if df is not None]
    if not parts:
        return None
    all_ = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    for c in (BATCH, VERSION):
        if c not in all_.columns:
            all_ = all_.withColumn(c, F.lit(None).cast("int"))
    names = [c for c in all_.columns if c not in (key, BATCH, VERSION)]
    keyed = all_.where(F.col(key).isNotNull())
    # the greatest whole row is found by sorting: dealt first, so that a task sorts no more than its part
    keyed = keyed.repartition(spread.tasks(keyed), key)

    def newest(df: DataFrame) -> DataFrame:
        row = F.struct(F.coalesce(VERSION, F.lit(-1)).alias("v"), F.coalesce(BATCH, F.lit(-1)).alias("b"), *names)
        return df.groupBy(key).agg(F.max(row).alias("_r")).select(key, *[F.col(f"_r.{n}").alias(n) for n in names], F.nullif(F.col("_r.b"), F.lit(-1)).alias(BATCH), F.nullif(F.col("_r.v"), F.lit(-1)).alias(VERSION))

    return newest(keyed).unionByName(all_.where(F.col(key).isNull()))


def suggested(batch: DataFrame, log: DataFrame | None, default: dict[str, float]) -> DataFrame:
    """``batch`` with suggested_parameters: the mean of those that succeeded so far with its interface_type, or ``default``.

    The means are one row a type; their join is left to the optimiser.
    """
    fixed = F.struct(*[F.lit(float(v)).alias(n) for n, v in default.items()])
    if log is None:
        return batch.withColumn("suggested_parameters", fixed)
    mean: Column = F.struct(*[F.avg(f"suggested_parameters.{n}").alias(n) for n in default])
    known = log.where("success").groupBy("interface_type").agg(mean.alias("_known"))
    return batch.join(known, "interface_type", "left").withColumn("suggested_parameters", F.coalesce("_known", fixed)).drop("_known")
