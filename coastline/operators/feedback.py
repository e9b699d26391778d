"""What a log of measurements teaches: outcomes, success statistics, learned parameters, reports.

A feedback table has timestamp, interface_type, features (struct),
suggested_parameters (struct), dimension_result, theoretical_dimension,
accuracy_score, r_squared, computation_time, success, failure_mode and
implementation. NULL and NaN differ: no result, and a result that is no number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastline.operators import rules

PARAMETERS = ("initial_delta", "delta_factor", "num_steps")
THRESHOLD = 0.95


def usable(dimension: str = "dimension_result") -> Column:
    return F.col(dimension).isNotNull() & ~F.isnan(F.col(dimension))


def error_percent() -> Column:
    return F.when(usable(), F.abs(F.col("dimension_result") - F.col("theoretical_dimension")) / F.col("theoretical_dimension") * 100)


def with_outcome(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """accuracy_score, success and failure_mode from the measured and the expected dimension."""
    d, t = F.col("dimension_result"), F.col("theoretical_dimension")
    df = df.withColumn("accuracy_score", F.when(usable() & t.isNotNull(), 1 - F.abs(d - t) / t))
    success = F.when(~usable(), False).when(t.isNotNull(), F.col("accuracy_score") > threshold).otherwise(F.coalesce(F.col("r_squared") > threshold, F.lit(False)))
    return df.withColumns({"success": success, "failure_mode": F.when(d.isNull(), "no_result").when(F.isnan(d), "nan_result")})


def parameter(name: str) -> Column:
    return F.col(f"suggested_parameters.{name}").cast("double")


def _ok(value: Column) -> Column:
    return F.when(F.col("success"), value)


def success_patterns(df: DataFrame, implementation: str | None = None) -> DataFrame:
    """Per implementation: records, successes, rate, and mean, deviation and range of each parameter over the successes."""
    if implementation is not None:
        df = df.where(F.col("implementation") == implementation)
    stats = [f(_ok(parameter(p))).alias(f"{p}_{n}") for p in PARAMETERS for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    out = df.groupBy("implementation").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"), *stats)
    return out.withColumns({"failures": F.col("total") - F.col("successes"), "success_rate": F.col("successes") / F.col("total")})


def learned_parameters(df: DataFrame) -> DataFrame:
    """Per class and implementation: records, successes, and the means over the successes (null without any)."""
    means = [F.avg(_ok(parameter(p))).alias(f"learned_{p}") for p in PARAMETERS]
    return df.groupBy("interface_type", "implementation").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("success").alias("n_success"), *means)


def adaptive_parameters(curves: DataFrame, log: DataFrame, implementation: str = "basic_box_counting", rotation=None) -> DataFrame:
    """Curves with interface_type and mean_segment_length -> parameters.

    Learned means where the class has successes, conservative ones where it has
    records only, the fallback table where it has none. The learned table has a
    row per class, so it joins without moving the curves once Spark sees its size.
    """
    learned = learned_parameters(log.where(F.col("implementation") == implementation)).drop("implementation")
    both = curves.join(learned, "interface_type", "left")
    plain, careful = rules.fallback_parameters(both), rules.conservative_parameters
    out = plain.withColumns({f"_f_{p}": F.col(p) for p in PARAMETERS})
    out = careful(out).withColumns({f"_c_{p}": F.col(p) for p in PARAMETERS})
    origin = F.when(F.col("n_records").isNull(), "fallback").when(F.col("n_success") == 0, "conservative").otherwise("learned")
    out = out.withColumn("source", origin)
    for p in PARAMETERS:
        chosen = F.when(F.col("source") == "learned", F.col(f"learned_{p}")).when(F.col("source") == "conservative", F.col(f"_c_{p}").cast("double")).otherwise(F.col(f"_f_{p}").cast("double"))
        out = out.withColumn(p, chosen.cast("int") if p == "num_steps" else chosen)
    drop = [f"{a}{p}" for p in PARAMETERS for a in ("_f_", "_c_", "learned_")]
    return rules.rotation_policy(out.drop(*drop, "n_records", "n_success"), rotation)


def recent_success(df: DataFrame, last: int = 10) -> DataFrame:
    """Success rate of each implementation's latest records."""
    w = Window.partitionBy("implementation").orderBy(F.col("timestamp").desc(), F.col("record_id").desc())
    out = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last)
    return out.groupBy("implementation").agg(F.count(F.lit(1)).alias("n_recent"), F.avg(F.col("success").cast("double")).alias("recent_success_rate"))


def learning_status(df: DataFrame, last: int = 10) -> DataFrame:
    total = df.groupBy("implementation").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    return total.join(recent_success(df, last), "implementation")


def accuracy_by_type(df: DataFrame) -> DataFrame:
    """Per class: usable results, least, mean and deviation of the error, mean fit, and the parameters of the least error."""
    rows = df.where(usable() & F.col("theoretical_dimension").isNotNull()).withColumn("error_pct", error_percent())
    best = F.min(F.struct("error_pct", "record_id", *[parameter(p).alias(p) for p in PARAMETERS])).alias("_b")
    out = rows.groupBy("interface_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("error_pct").alias("min_error"), F.avg("error_pct").alias("avg_error"), F.stddev_pop("error_pct").alias("std_error"), F.avg("r_squared").alias("avg_r_squared"), best
    )
    return out.select("*", *[F.col(f"_b.{p}").alias(f"best_{p}") for p in PARAMETERS]).drop("_b")


def parameter_trend(df: DataFrame) -> DataFrame:
    """Per class: first and last parameters in time, and how many different ones there were."""
    at = F.struct("timestamp", "record_id")
    cols = [F.count(F.lit(1)).alias("n")]
    for p in PARAMETERS:
        cols += [F.min_by(parameter(p), at).alias(f"first_{p}"), F.max_by(parameter(p), at).alias(f"last_{p}"), F.countDistinct(parameter(p)).alias(f"distinct_{p}")]
    return df.groupBy("interface_type").agg(*cols)


def optimal_ranges(df: DataFrame) -> DataFrame:
    """Per class: ranges and means of the parameters over the half with the smallest errors."""
    rows = df.where(usable() & F.col("theoretical_dimension").isNotNull()).withColumn("error_pct", error_percent())
    median = rows.groupBy("interface_type").agg(F.expr("percentile(error_pct, 0.5)").alias("median_error"))
    rows = rows.join(median, "interface_type").where("error_pct <= median_error")
    stats = [f(parameter(p)).alias(f"{p}_{n}") for p in PARAMETERS for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return rows.groupBy("interface_type", "median_error").agg(F.count(F.lit(1)).alias("n"), *stats)


def implementation_comparison(df: DataFrame) -> DataFrame:
    e = error_percent()
    return df.groupBy("implementation").agg(F.count(F.lit(1)).alias("total"), (F.avg(F.col("success").cast("double")) * 100).alias("success_rate"), F.count(e).alias("n_valid"), F.avg(e).alias("avg_error"), F.min(e).alias("min_error"))


def level_of(n_segments: Column) -> Column:
    """The level of a Koch curve of 4, 16, 64 or 256 segments."""
    return F.when(n_segments == 4, 1).when(n_segments == 16, 2).when(n_segments == 64, 3).when(n_segments == 256, 4)


def _levels(df: DataFrame) -> DataFrame:
    return df.where(F.col("interface_type") == "koch_curve").withColumns({"level": level_of(F.col("features.n_segments")), "error_pct": error_percent()})


def by_level(df: DataFrame) -> DataFrame:
    """Per level: results, errors, and the parameters of the least error."""
    best = F.min(F.when(F.col("error_pct").isNotNull(), F.struct("error_pct", "record_id", parameter("initial_delta").alias("initial_delta")))).alias("_b")
    out = _levels(df).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("successes"), F.min("error_pct").alias("min_error"), F.avg("error_pct").alias("avg_error"), best)
    return out.select("*", F.col("_b.initial_delta").alias("best_initial_delta")).drop("_b")


def parameter_matrix(df: DataFrame) -> DataFrame:
    """Mean error by parameter signature and level."""
    sig = F.format_string("%.2f/%.2f/%d", parameter("initial_delta"), parameter("delta_factor"), F.col("suggested_parameters.num_steps").cast("bigint"))
    return _levels(df).where("error_pct is not null").groupBy(sig.alias("signature"), "level").agg(F.count(F.lit(1)).alias("n"), F.avg("error_pct").alias("avg_error"))


def level_complexity(df: DataFrame) -> DataFrame:
    out = _levels(df).where("error_pct is not null and level is not null").groupBy("level").agg(F.min("error_pct").alias("best_error"), F.avg("error_pct").alias("avg_error"))
    return out.withColumns({"segments": F.pow(F.lit(4.0), F.col("level")).cast("bigint"), "grade": rules.tier(F.col("avg_error"), [(10, "good"), (15, "moderate")], "poor")})


def pattern_stats(df: DataFrame, good: float = 10.0) -> DataFrame:
    """Parameter means and deviations of successes and failures, and how many errors are small."""
    e = error_percent()
    stats = [f(parameter(p)).alias(f"{p}_{n}") for p in PARAMETERS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy("success").agg(F.count(F.lit(1)).alias("n"), *stats, F.avg(e).alias("avg_error"), F.count(F.when(e < good, 1)).alias("n_small_errors"))


def success_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("interface_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"))


def feature_coverage(df: DataFrame) -> DataFrame:
    """How many records there are and how many different features they have; readiness by the number of records."""
    keys = F.explode(F.map_keys(F.from_json(F.to_json("features"), "map<string,string>")))
    names = df.select(keys.alias("k")).agg(F.countDistinct("k").alias("n_features"))
    n = df.agg(F.count(F.lit(1)).alias("n_records"))
    return n.crossJoin(names).withColumn("readiness", rules.tier(F.col("n_records"), [(20, "insufficient"), (30, "limited")], "ready"))  # one row each


#: Continued fraction steps; for the incomplete beta function at 2 r <= 1 far fewer change anything.
BETA_STEPS = 200


def t_test(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson r over n rows: the incomplete beta function I_x(n / 2 - 1, 1 / 2) at x = 1 - r ** 2.

    It is evaluated by its continued fraction (modified Lentz), with x swapped for
    1 - x where that converges faster; the fold over the steps is an expression.
    """
    # a and b are half integers, so the gamma functions' quotient is a product that a fold gives
    df = n - 2
    a, x = df.cast("double") / 2, F.greatest(F.lit(0.0), 1 - r * r)
    # log of gamma(a + 1/2) / (gamma(a) gamma(1/2)) from its value at a = 1/2 or 1
    start = F.when(df % 2 == 1, -F.log(F.lit(math.pi))).otherwise(F.lit(-math.log(2)))
    first = F.when(df % 2 == 1, 0.5).otherwise(1.0)
    count = F.when(df >= 3, F.floor((a - first) + 0.25)).otherwise(F.lit(0)).cast("int")
    log_beta = start + F.when(count > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.lit(0.0), lambda acc, k: acc + F.log((first + k + 0.5) / (first + k)))).otherwise(F.lit(0.0))

    def fraction(p: Column, q: Column, z: Column) -> Column:
        tiny = F.lit(1e-300)
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        d0 = 1 / safe(1 - (p + q) * z / (p + 1))

        def step(acc: Column, m: Column) -> Column:
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1 / safe(1 + even * acc["d"])
            c = safe(1 + even / acc["c"])
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d2 = 1 / safe(1 + odd * d)
            c2 = safe(1 + odd / c)
            return F.struct(c2.alias("c"), d2.alias("d"), (acc["h"] * d * c * d2 * c2).alias("h"))

        zero = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(BETA_STEPS)), zero, step, lambda acc: acc["h"])

    half = F.lit(0.5)
    front = F.exp(log_beta + a * F.log(F.greatest(x, F.lit(1e-300))) + half * F.log(F.greatest(1 - x, F.lit(1e-300))))
    value = F.when(x < (a + 1) / (a + 2.5), front * fraction(a, half, x) / a).otherwise(1 - front * fraction(half, a, 1 - x) / half)
    return F.when(r.isNull() | (n < 3), F.lit(None).cast("double")).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def correlations(df: DataFrame, features: list[str], parameters: list[str]) -> DataFrame:
    """Pearson r of each feature with each parameter over rows that have both: feature, parameter, n, r, p and its stars.

    All pairs come from one pass; a pair with fewer than 3 rows or without
    variance has a null r.
    """
    both = [F.struct(F.lit(f).alias("feature"), F.lit(p).alias("parameter"), F.col(f).cast("double").alias("x"), F.col(p).cast("double").alias("y")) for f in features for p in parameters]
    rows = df.select(F.inline(F.array(*both))).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    out = rows.groupBy("feature", "parameter").agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    r = F.expr("case when n >= 3 and sxx > 0 and syy > 0 then greatest(-1D, least(1D, sxy / sqrt(sxx * syy))) end")
    out = out.select("feature", "parameter", "n", r.alias("r"))
    out = out.withColumn("p", t_test(F.col("r"), F.col("n")))
    return out.withColumn("stars", F.when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def strong(found: DataFrame, least: float = 0.3, most_p: float = 0.05) -> DataFrame:
    """Correlations that are strong and significant, with their direction."""
    out = found.where((F.abs("r") > least) & (F.col("p") < most_p))
    return out.select("feature", "parameter", "r", "p", F.when(F.col("r") > 0, "increases").otherwise("decreases").alias("direction"))
