"""Ordered work inside a key whose rows are too many for one task.

A window over a key sorts all its rows in one task. Here rows are numbered by
ranges instead: a range partition has rows of neighbouring keys and places, and
what comes before it is a count for each partition. Once rows are numbered, a
key is cut into chunks of ``CHUNK`` places; sums run inside chunks and over the
chunks' sums (two levels, and more if there are many chunks), and a window that looks
a few places around gets those places of the neighbouring chunks as a halo.

Rows: those whose key is null are left out; equal rows are numbered in any order.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Places of a chunk.
CHUNK = 4096
#: Rows of one partition: a task sorts and aggregates that many several times over.
ROWS = 1 << 17


def tasks(df: DataFrame, rows: int | None = None) -> int:
    """Partitions for ``df``: the session's number, or more, so that none has many more rows than ``ROWS``.

    ``rows`` is the number of rows where it is known; it is counted otherwise, which for a
    file takes its footers only. A number that is given isn't made smaller by bytes.
    """
    n = df.count() if rows is None else rows
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``, as in tests) may leave it unset.
    """
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or os.path.join(tempfile.gettempdir(), "coastline-checkpoints")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/coastline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def fresh(n: int = 1) -> list[str]:
    """Names of columns that no caller's table has."""
    return [f"_{uuid.uuid4().hex}" for _ in range(n)]


def numbered(df: DataFrame, key: str, order: list[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with the place of each row in its key, from 0, in ``order``.

    No task gets more than a range partition or a part of a key in it. Of the
    counts that are broadcast there is at most one for each partition: a key's
    rows that begin in an earlier one.
    """
    part, before, n = fresh(3)
    ranged = written(df.where(F.col(key).isNotNull()).repartitionByRange(F.col(key), *order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(key, part).agg(F.count(F.lit(1)).alias(n))
    earlier = F.sum(n).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn(before, earlier).where(F.col(before).isNotNull()).select(F.col(key).alias(n), F.col(part).alias(f"{n}p"), before)
    at = F.row_number().over(Window.partitionBy(key, part).orderBy(*order)) - 1
    placed = ranged.withColumn(name, at.cast("long"))
    placed = placed.join(F.broadcast(starts), (F.col(key) == F.col(n)) & (F.col(part) == F.col(f"{n}p")), "left")
    return placed.withColumn(name, F.col(name) + F.coalesce(before, F.lit(0))).drop(part, before, n, f"{n}p")


def chunk_of(pos: Column, length: int = CHUNK) -> Column:
    return F.floor(pos / length).cast("long")


def haloed(df: DataFrame, pos: str, before: int, after: int, length: int | None = None, chunk: str = "chunk", own: str = "own") -> DataFrame:
    """Rows with their chunk, and once more for each neighbouring chunk that sees them within ``before`` or ``after`` places.

    Of a row's copies only that of its own chunk has ``own``. A window over
    (key, chunk) then sees the same places around an own row as one over the key.
    """
    at, length = F.col(pos), length or CHUNK
    first, last = chunk_of(at - F.lit(after), length), chunk_of(at + F.lit(before), length)
    chunks = F.sequence(F.greatest(first, F.lit(0).cast("long")), last)
    return df.withColumn(chunk, F.explode(chunks)).withColumn(own, F.col(chunk) == chunk_of(at, length))


def in_chunks(df: DataFrame, key: str, pos: str, before: int, after: int, kernel: Callable[[DataFrame, WindowSpec], DataFrame], length: int | None = None) -> DataFrame:
    """``kernel(rows, window)`` over the chunks of a key instead of the whole key.

    The kernel adds columns by windows that look at most ``before`` places back and
    ``after`` ahead; ``window`` is a chunk's rows with their halo, in order.
    """
    chunk, own = fresh(2)
    rows = haloed(df, pos, before, after, length or CHUNK, chunk, own)
    return kernel(rows, Window.partitionBy(key, chunk).orderBy(pos)).where(F.col(own)).drop(chunk, own)


def with_totals(df: DataFrame, key: str, **totals: Column) -> DataFrame:
    """``df`` with aggregates of each key; a plain join of two tables, of which Spark splits a hot key."""
    k = fresh()[0]
    per = written(df.groupBy(F.col(key).alias(k)).agg(*[c.alias(n) for n, c in totals.items()]))
    return df.join(per, F.col(key) == F.col(k)).drop(k)


def running_sums(df: DataFrame, key: str, pos: str, sums: dict[str, Column], length: int | None = None, backwards: bool = False) -> DataFrame:
    """``df`` with running sums of columns over the places of a key, in their order or from the last.

    ``pos`` tells the places of a key apart, or rows of one place count together only
    once all of them are passed. Chunks whose sums are themselves many are summed
    by the same rule.
    """
    length = length or CHUNK
    if length < 2:
        raise ValueError("a chunk has two places or more")
    chunk, offset = fresh(2)
    names = list(sums)
    parts = dict(zip(names, fresh(len(names)), strict=True))
    rows = df.withColumn(chunk, chunk_of(F.col(pos), length)).withColumns({parts[n]: c for n, c in sums.items()})
    order = F.col(pos).desc() if backwards else F.col(pos)
    inside = Window.partitionBy(key, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({n: F.sum(parts[n]).over(inside) for n in names})
    longest = df.agg(F.max(pos)).first()[0]
    if longest is None or longest < length:
        return own.drop(chunk, *parts.values())
    k, at = fresh(2)
    totals = rows.groupBy(F.col(key).alias(k), F.col(chunk).alias(at)).agg(*[F.sum(parts[n]).alias(parts[n]) for n in names])
    carried = running_sums(written(totals), k, at, {n: F.col(parts[n]) for n in names}, length, backwards)
    carried = carried.select(F.col(k), F.col(at), *[(F.col(n) - F.col(parts[n])).alias(f"{offset}{i}") for i, n in enumerate(names)])
    both = own.join(carried, (F.col(key) == F.col(k)) & (F.col(chunk) == F.col(at)))
    return both.withColumns({n: F.col(n) + F.col(f"{offset}{i}") for i, n in enumerate(names)}).drop(chunk, k, at, *parts.values(), *[f"{offset}{i}" for i in range(len(names))])
