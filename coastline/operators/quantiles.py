"""Exact quantiles of groups of any size.

``percentile`` keeps all different values of a group in one task. Here values are
numbered over range partitions (``spread.numbered``), so that a group that holds a
third of all rows lies over many tasks, and each quantile reads the two rows it falls
between.

Rows: null values and NaN count for nothing; a group without another value has no row;
rows whose key is null are left out; equal values each have a place of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.operators import spread


def exact(df: DataFrame, key: str, value: str, shares: Sequence[float], name: str = "quantiles") -> DataFrame:
    """(key, n, quantiles): values at ``shares`` of the way from the least to the greatest, between two rows in proportion."""
    if not shares or any(not 0 <= p <= 1 for p in shares):
        raise ValueError("shares lie from 0 to 1, and there is one at least")
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    placed = spread.with_totals(spread.numbered(rows, "key", ["value"]), "key", n=F.count(F.lit(1)))
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    # of all rows only those next to a quantile go on: two a share and group
    sides = F.array(*[F.struct(F.lit(i).alias("i"), h.alias("h")) for i, h in enumerate(at)])
    near = placed.select("key", "n", "value", F.explode(F.filter(sides, lambda s: F.abs(F.col("pos") - s["h"]) < 1)).alias("s"))
    each = near.groupBy("key", "n", "s.i", "s.h").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    each = each.select("key", "n", "i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("q"))
    out = each.groupBy("key", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias(name))
    return out.withColumnRenamed("key", key)
