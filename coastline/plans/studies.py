"""Whole studies: optimised parameters with their report, runs over frames, libraries of curves, sweeps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.operators import boxcount, contour, convergence, curves, features, feedback, generators, rules, search, temporal
from coastline.plans import comprehensive
from coastline.sources import fields

FOUND = ("curve_id", "initial_delta", "delta_factor", "num_steps")


def optimise(segs: DataFrame, target: float, method: str = "grid") -> tuple[DataFrame, DataFrame | None]:
    """Parameters whose dimension is nearest to the target, measured, and all that a grid search has scored.

    The first: curve_id, initial_delta, delta_factor, num_steps, final_delta,
    dimension, error, r_squared, std_err. The grid follows the smaller side of one
    curve's box, so ``segs`` holds one curve.
    """
    boxes = curves.bounding_boxes(segs).limit(2).collect()
    if len(boxes) != 1:
        raise ValueError("optimise takes the segments of one curve")
    scored = None
    if method == "grid":
        scored = search.evaluate(segs, search.default_grid(segs.sparkSession, min(boxes[0].width, boxes[0].height)), target)
        best = search.best(scored).select(*FOUND)
    elif method == "differential_evolution":
        best = search.differential_evolution(segs, target).select(*FOUND)
    else:
        raise ValueError(f"unknown method: {method}")
    dims = boxcount.dimensions(segs, curves.bounding_boxes(segs).join(best, "curve_id"))
    out = best.join(dims, "curve_id").withColumns({"final_delta": F.col("initial_delta") / F.pow("delta_factor", F.col("num_steps") - 1), "error": F.abs(F.col("dimension") - target)})
    return out.select(*FOUND, "final_delta", "dimension", "error", "r_squared", "std_err"), scored


def report(best: DataFrame, scored: DataFrame | None, target: float, name: str, method: str = "grid", top: int = 20) -> list[str]:
    """The lines of a text report: one row of parameters and at most ``top`` more come to the driver."""
    r = best.first()
    out = ["Box-counting parameters", f"Curve: {name}", f"Target dimension: {target}", f"Method: {method}", ""]
    if r is None:
        return [*out, "No parameters are valid."]
    out += [f"{label + ':':<22}{value}" for label, value in (
        ("Initial delta", f"{r.initial_delta:.6f}"), ("Delta factor", f"{r.delta_factor:.6f}"), ("Number of steps", r.num_steps), ("Final delta", f"{r.final_delta:.6f}"), ("Dimension", f"{r.dimension:.8f}"),
        ("Error", f"{r.error:.8f}"), ("R-squared", f"{r.r_squared:.10f}"), ("Standard error", f"{r.std_err:.8f}"),
    )]
    if scored is not None:
        out += ["", f"{'Rank':<6}{'Initial delta':<15}{'Factor':<10}{'Steps':<7}{'Dimension':<13}{'R-squared':<14}Score"]
        out += [f"{k:<6}{x.initial_delta:<15.6f}{x.delta_factor:<10.4f}{x.num_steps:<7}{x.dimension:<13.8f}{x.r_squared:<14.10f}{x.score:.6f}" for k, x in enumerate(search.top(scored, top).collect(), 1)]
    return out


def write_report(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def evolution(field: DataFrame, level: float = 0.5, series_id: str = "run", applied: bool = True) -> DataFrame:
    """Frames of a field (time, ix, iy, x, y, f) -> parameters carried from frame to frame, and dimensions measured with them.

    The carried parameters start so small that long ladders fail the gate of the
    smallest size; with ``applied`` off they are only reported, and every frame is
    measured with eight sizes from a fifth of its larger side down. A frame whose
    parameters fail a gate has no dimension. A frame without a contour keeps its row, with
    0 segments and neither parameters nor dimension, and the carried parameters pass
    it by.
    """
    segs = contour.contours(field, level)
    box = curves.bounding_boxes(segs)
    sizes = box.join(segs.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n_segments")), "curve_id")
    frames = sizes.select(F.lit(series_id).alias("series_id"), F.col("curve_id").cast("double").alias("time"), "n_segments", F.greatest("width", "height").alias("domain_scale"))
    params = temporal.recurrence(frames)
    sets = box.join(params.withColumn("curve_id", F.col("time").cast("string")), "curve_id").drop("series_id", "time", "n_segments")
    if not applied:
        sets = sets.withColumns({"initial_delta": F.greatest("width", "height") / 5, "delta_factor": F.lit(1.5), "num_steps": F.lit(8)})
    dims = boxcount.dimensions(segs, sets).select(F.col("curve_id").cast("double").alias("time"), F.when(F.col("valid"), F.col("dimension")).alias("dimension"), F.when(F.col("valid"), F.col("r_squared")).alias("r_squared"))
    every = field.select(F.col("time").cast("double").alias("time")).distinct().withColumn("series_id", F.lit(series_id))
    out = every.join(params.drop("series_id"), "time", "left").join(dims, "time", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)).cast("long"))
    return out.select("series_id", "time", "n_segments", "initial_delta", "delta_factor", "num_steps", "dimension", "r_squared")


def evolution_of_files(spark: SparkSession, folder: str, start: float, end: float, step: float, level: float = 0.5) -> DataFrame:
    """The same over the frames of a folder that lie on a range of times."""
    wanted = temporal.wanted_stamps(spark, start, end, step).select((F.col("stamp") / 1000).alias("time"))
    field = fields.read_vtk(spark, folder)
    return evolution(field.join(F.broadcast(wanted), "time", "left_semi"), level)  # one row for each wanted time


def levels(spark: SparkSession) -> DataFrame:
    """(fractal, level, n_segments, theoretical_dimension): the library's 36 curves."""
    #: Levels and dimensions of the library.
    family = [("koch", 1, 7, 1.2619), ("dragon", 3, 12, 2.0), ("hilbert", 2, 8, 2.0), ("minkowski", 1, 6, 1.5), ("sierpinski", 3, 8, 1.585)]
    rows = [(f, n, d) for f, a, b, d in family for n in range(a, b + 1)]
    size = "case fractal when 'hilbert' then pow(4, level) - 1 when 'minkowski' then pow(8, level) when 'sierpinski' then pow(3, level + 1) else pow(4, level) end"
    return spark.createDataFrame(rows, "fractal string, level int, theoretical_dimension double").selectExpr("fractal", "level", f"cast({size} as bigint) as n_segments", "theoretical_dimension")


def make(spark: SparkSession, fractal: str, level: int) -> DataFrame:
    """A curve by name and level, called ``name_Llevel``."""
    if fractal == "koch":
        segs = generators.koch(spark, level)
    elif fractal == "hilbert":
        segs = generators.hilbert(spark, level)
    else:
        segs = generators.lsystem(spark, {"dragon": "dragon_lsystem"}.get(fractal, fractal), level)
    return segs.withColumn("curve_id", F.lit(f"{fractal}_L{level}"))


def library(spark: SparkSession, with_methods: bool = False) -> DataFrame:
    """Features and class of every curve of the library that is within its budget of segments; with the methods' consensus if asked for."""
    affordable = convergence.within_budget(levels(spark), generators.registry(spark))
    curves_ = affordable.join(levels(spark).select("fractal", "level", "theoretical_dimension"), ["fractal", "level"]).orderBy("fractal", "level").collect()  # at most 36 rows
    segs = reduce(DataFrame.unionByName, [make(spark, r.fractal, r.level) for r in curves_])
    names = spark.createDataFrame([(f"{r.fractal}_L{r.level}", r.fractal, r.level, r.theoretical_dimension) for r in curves_], "curve_id string, fractal string, level int, theoretical_dimension double")
    out = names.join(rules.classify(features.features(segs)), "curve_id")
    return out.join(comprehensive.analyse(segs), "curve_id", "left") if with_methods else out


def write_library(records: DataFrame, path: str) -> None:
    """The library as JSON lines, a record a curve."""
    records.write.mode("overwrite").json(path)


#: Curves and parameters of the sweep.
SWEPT = (("koch", 3), ("koch", 4), ("koch", 5), ("dragon", 3), ("dragon", 4), ("sierpinski", 3), ("sierpinski", 4), ("sierpinski", 5))
SWEPT_DIMENSION = {"koch": 1.2619, "dragon": 1.5236, "sierpinski": 1.584963}
SWEPT_GRID = ([0.5, 0.8, 1.0, 1.2, 1.5, 2.0], [1.1, 1.2, 1.3, 1.5, 1.8], [10, 12, 15, 18, 20])


def sweep(spark: SparkSession, sample: int | None = 60, seed: int = 42, good: float = 15.0) -> DataFrame:
    """Every combination of curve and parameters, or a repeatable sample of them, measured: curve_id, parameters, dimension, r_squared, error_pct, success."""
    combos = generators.parameter_grid(spark, *SWEPT_GRID)
    picked = combos.select("*", F.explode(F.array(*[F.struct(F.lit(f"{f}_L{n}").alias("curve_id"), F.lit(SWEPT_DIMENSION[f]).alias("theoretical_dimension")) for f, n in SWEPT])).alias("c")).select("c.*", *combos.columns)
    if sample is not None:
        picked = picked.orderBy(F.xxhash64(F.lit(seed), "curve_id", "combo_idx"), "curve_id", "combo_idx").limit(sample)
    segs = reduce(DataFrame.unionByName, [make(spark, f, n) for f, n in SWEPT])
    dims = boxcount.dimensions(segs, picked.join(curves.bounding_boxes(segs), "curve_id"), ("curve_id",), ("combo_idx",))
    out = picked.join(dims, ["curve_id", "combo_idx"])
    out = out.withColumn("error_pct", F.when(F.col("valid"), F.abs(F.col("dimension") - F.col("theoretical_dimension")) / F.col("theoretical_dimension") * 100))
    return out.withColumn("success", F.coalesce(F.col("error_pct") < good, F.lit(False))).drop("std_err", "valid")


def records_of_sweep(spark: SparkSession, swept: DataFrame, implementation: str = "basic_box_counting") -> DataFrame:
    """The valid rows of a sweep as records for the feedback log."""
    segs = reduce(DataFrame.unionByName, [make(spark, f, n) for f, n in SWEPT])
    typed = rules.classify(features.features(segs))
    rows = swept.where("error_pct is not null").join(typed, "curve_id")
    out = rows.select(
        "curve_id", "interface_type", F.struct(*[F.col(f).cast("double").alias(f) for f in features.FEATURES]).alias("features"), F.struct("initial_delta", "delta_factor", F.col("num_steps").cast("double").alias("num_steps")).alias("suggested_parameters"),
        F.col("dimension").alias("dimension_result"), "theoretical_dimension", "r_squared", F.lit(implementation).alias("implementation"),
    )
    return feedback.with_outcome(out)
