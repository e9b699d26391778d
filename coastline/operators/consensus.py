"""Several methods' parameters into one: means weighted by method and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the methods, and of an unknown one.
WEIGHTS = {"spectrum": 0.25, "wavelet": 0.25, "curvature": 0.20, "self_similarity": 0.25, "traditional": 0.05}
OTHER_WEIGHT = 0.2
#: What a curve gets that no method could handle.
DEFAULT = {"initial_delta": 0.01, "delta_factor": 1.5, "num_steps": 12, "confidence": 0.1}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def method_weight() -> Column:
    return reduce(lambda a, x: F.when(F.col("method") == x[0], F.lit(x[1])).otherwise(a), WEIGHTS.items(), F.lit(OTHER_WEIGHT))


def consensus(methods: DataFrame) -> DataFrame:
    """(curve_id, method, initial_delta, delta_factor, num_steps, confidence) -> one row per curve.

    Methods with a parameter that is no finite number, or without confidence,
    don't count; the confidence is the plain mean of the others'.
    """
    p = ["initial_delta", "delta_factor", "num_steps"]
    valid = reduce(lambda a, b: a & b, [finite(F.col(c).cast("double")) for c in p]) & (F.col("confidence") > 0)
    w = F.when(valid, method_weight() * F.col("confidence"))
    sums = [F.sum(w * F.col(c)).alias(f"_{c}") for c in p]
    out = methods.groupBy("curve_id").agg(F.sum(w).alias("_w"), *sums, F.avg(F.when(valid, F.col("confidence"))).alias("_conf"), F.count(F.when(valid, 1)).alias("n_methods"))
    some = F.col("n_methods") > 0
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return out.select(
        "curve_id", "n_methods",
        F.when(some, clip(F.col("_initial_delta") / F.col("_w"), 1e-6, 1e6)).otherwise(DEFAULT["initial_delta"]).alias("initial_delta"),
        F.when(some, clip(F.col("_delta_factor") / F.col("_w"), 1.1, 3.0)).otherwise(DEFAULT["delta_factor"]).alias("delta_factor"),
        F.when(some, clip(F.bround(F.col("_num_steps") / F.col("_w"), 0), 5.0, 50.0)).otherwise(float(DEFAULT["num_steps"])).cast("int").alias("num_steps"),
        F.when(some, F.col("_conf")).otherwise(DEFAULT["confidence"]).alias("confidence"),
    )


def summary(methods: DataFrame) -> DataFrame:
    """Per method: rows, rows that count, mean, least and largest confidence."""
    ok = F.col("confidence") > 0
    return methods.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_valid"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def parameter_error(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """Mean error in percent over the three parameters (infinite where the actual one is 0), and a word for it."""
    p = ["initial_delta", "delta_factor", "num_steps"]
    both = pred.select("curve_id", *p).join(actual.select("curve_id", *[F.col(c).alias(f"a_{c}") for c in p]), "curve_id")
    errors = [F.when(F.col(f"a_{c}") == 0, F.lit(float("inf"))).otherwise(F.abs(F.col(c) - F.col(f"a_{c}")) / F.abs(F.nullif(F.col(f"a_{c}"), F.lit(0))) * 100) for c in p]
    out = both.select("curve_id", (reduce(lambda a, b: a + b, errors) / 3).alias("error_pct"))
    return out.withColumn("grade", F.when(F.col("error_pct") < 50, "good").when(F.col("error_pct") < 100, "fair").otherwise("poor"))


def truncating(methods: DataFrame, scales: DataFrame, n_methods: int = 4) -> DataFrame:
    """Another consensus: means weighted by confidence alone, whole steps cut off, confidence over ``n_methods``.

    scales: (curve_id, domain_scale), for curves without a method that counts.
    """
    w = F.when(F.col("confidence") > 0, F.col("confidence"))
    sums = [F.sum(w * F.col(c)).alias(f"_{c}") for c in ("initial_delta", "delta_factor", "num_steps")]
    out = scales.join(methods.groupBy("curve_id").agg(F.sum(w).alias("_w"), *sums), "curve_id", "left")
    some = F.col("_w").isNotNull()
    return out.select(
        "curve_id", F.when(some, F.col("_initial_delta") / F.col("_w")).otherwise(F.col("domain_scale") / 100).alias("initial_delta"), F.when(some, F.col("_delta_factor") / F.col("_w")).otherwise(1.5).alias("delta_factor"),
        F.when(some, F.floor(F.col("_num_steps") / F.col("_w"))).otherwise(15).cast("int").alias("num_steps"), F.coalesce(F.col("_w") / n_methods, F.lit(0.0)).alias("confidence"),
    )


def scale_candidates(params: DataFrame) -> DataFrame:
    """(curve_id, initial_delta, delta_factor, num_steps, domain_width, interface_width) -> four sets to try for each curve."""
    own = [F.col("delta_factor"), F.floor("num_steps").cast("int")]
    sets = [("suggested", F.col("initial_delta"), *own), ("domain_scaled", F.col("domain_width") * 0.05, *own), ("interface_scaled", F.col("interface_width") * 0.2, *own), ("conservative", F.lit(0.01), F.lit(1.5), F.lit(20))]
    rows = [F.struct(F.lit(i).alias("combo_idx"), F.lit(n).alias("name"), d.cast("double").alias("initial_delta"), f.cast("double").alias("delta_factor"), k.alias("num_steps")) for i, (n, d, f, k) in enumerate(sets)]
    return params.select("curve_id", F.inline(F.array(*rows)))


def best_fit(measured: DataFrame) -> DataFrame:
    """Of each curve's measured sets (combo_idx, dimension, r_squared) the first with the best fit."""
    ok = measured.where("dimension is not null and not isnan(dimension)")
    rest = [c for c in measured.columns if c != "curve_id"]
    return ok.groupBy("curve_id").agg(F.min_by(F.struct(*rest), F.struct(-F.col("r_squared"), "combo_idx")).alias("b")).select("curve_id", "b.*")
