"""Composite analyses: five methods and their consensus, measured trials, and the learning loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.operators import boxcount, consensus, curvature, curves, feedback, features, rules, selfsim, spectrum, spread

METHOD = ("curve_id", "method", "initial_delta", "delta_factor", "num_steps", "confidence")


def _long(df: DataFrame, method: str) -> DataFrame:
    return df.select("curve_id", F.lit(method).alias("method"), F.col("initial_delta").cast("double"), F.col("delta_factor").cast("double"), F.col("num_steps").cast("double"), F.col("confidence").cast("double"))


def method_rows(segs: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Parameters and confidence of each curve by each method, in long form.

    A method that can't handle a curve gives no row or one without confidence,
    which the consensus leaves out; the other methods go on. Each method's rows, one a
    curve, are written, so that no task holds the sorts and tables of all methods at once.
    """
    box = curves.bounding_boxes(segs)
    scale = box.select("curve_id", F.when(F.col("width") > 0, F.col("width")).otherwise(1.0).alias("domain_scale"))
    heights = spectrum.height_function(segs, spectrum.POINTS)
    spectral = spectrum.spectral_parameters(spectrum.spectral_features(heights).where("error is null").join(scale, "curve_id"))
    wave = spectrum.wavelet_parameters(spectrum.wavelet_features(heights).where("error is null"))
    bend = curvature.confidence(curvature.parameters(curvature.features(segs).join(scale, "curve_id")))
    signal = spectrum.height_function(segs, 256).select(F.col("curve_id").alias("series_id"), F.posexplode("heights").alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))
    signal = spread.written(signal)
    # no signal is long here: dealt by signal, so that blocks of all sizes are summed where they are
    signal = signal.repartition(spread.tasks(signal), "series_id")
    own = selfsim.row(signal).withColumnRenamed("series_id", "curve_id").join(scale, "curve_id")
    own = self_similarity_confidence(selfsim.parameters(own))
    typed = rules.classify(features.features(segs))
    plain = feedback.adaptive_parameters(typed, log) if log is not None else rules.fallback_parameters(typed)
    rows = [_long(spectral, "spectrum"), _long(wave, "wavelet"), _long(bend, "curvature"), _long(own, "self_similarity"), _long(plain.withColumn("confidence", F.lit(0.7)), "traditional")]
    out, *others = [spread.written(r) for r in rows]
    for r in others:
        out = out.unionByName(r)
    return out


def self_similarity_confidence(df: DataFrame) -> DataFrame:
    """0..1 from how the estimates agree, the scaling's quality, the character and the strength."""
    df = selfsim.properties(df)
    s, q, t = F.col("hurst_variation"), F.coalesce("scaling_quality", F.lit(0.0)), F.col("self_similarity_strength")
    agree = F.when(s.isNull(), 0.6).when(s < 0.1, 1.0).when(s < 0.2, 0.9).when(s < 0.3, 0.8).otherwise(0.6)
    fit = F.when(F.isnan(q), 0.7).when(q > 0.9, 1.0).when(q > 0.8, 0.95).when(q > 0.7, 0.9).otherwise(0.7)
    kind = F.when(F.col("fractal_character") == "strong_fractal", 1.0).when(F.col("fractal_character") == "moderate_fractal", 0.9).when(F.col("fractal_character") == "weak_fractal", 0.8).otherwise(0.6)
    strong = F.when(t.isNull() | F.isnan(t), 1.0).when(t > 0.5, 1.0).when(t > 0.3, 0.95).otherwise(0.9)
    return df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), agree * fit * F.col("hurst_confidence") * kind * strong)))


def analyse(segs: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The consensus of all methods for each curve."""
    return consensus.consensus(method_rows(segs, log))


def measure(segs: DataFrame, params: DataFrame, expected: DataFrame, implementation: str = "basic_box_counting") -> DataFrame:
    """Box-count curves with parameters (curve_id, initial_delta, delta_factor, num_steps) and score them against (curve_id, theoretical_dimension).

    The rows are feedback records without a timestamp.
    """
    typed = rules.classify(features.features(segs))
    domain = curves.padded(curves.bounding_boxes(segs)).select("curve_id", "xmin", "xmax", "ymin", "ymax")
    dims = boxcount.dimensions(segs, domain.join(params.select("curve_id", "initial_delta", "delta_factor", "num_steps"), "curve_id"))
    out = typed.join(dims, "curve_id").join(params.select("curve_id", F.struct("initial_delta", "delta_factor", F.col("num_steps").cast("double").alias("num_steps")).alias("suggested_parameters")), "curve_id").join(expected, "curve_id", "left")
    out = out.select(
        "curve_id", "interface_type", F.struct(*[F.col(f).cast("double").alias(f) for f in features.FEATURES]).alias("features"), "suggested_parameters", F.col("dimension").alias("dimension_result"), "theoretical_dimension", "r_squared",
        F.lit(implementation).alias("implementation"),
    )
    return feedback.with_outcome(out)


def learning_round(segs: DataFrame, expected: DataFrame, log: DataFrame, implementation: str = "basic_box_counting") -> DataFrame:
    """One micro-batch of the loop: suggest from the log, measure, and return records for it.

    All curves of a round run side by side; the next round sees what this one
    has appended. ``foreachBatch`` of a stream of curves calls the same.
    """
    typed = rules.classify(features.features(segs))
    return measure(segs, feedback.adaptive_parameters(typed, log, implementation), expected, implementation)
