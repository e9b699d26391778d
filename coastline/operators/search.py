"""Parameter searches: a grid, and differential evolution whose generations are DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastline.operators import boxcount, curves, generators, spread

#: Fixed values of the grid: 8 deltas from m / 10 to m / 2 (log), 10 factors from 1.3 to 2.5, 7 step counts.
STEPS = (8, 10, 12, 14, 16, 18, 20)
#: Fixed values of the evolution: generations at most, people for each parameter, and how alike their scores end.
GENERATIONS, PEOPLE, TOLERANCE = 100, 15, 1e-6
#: Generations without a better best after which the search ends; in trials the best was found within half as many.
PATIENCE = 10


def linspace(a: float, b: float, n: int) -> list[float]:
    return [a + (b - a) * i / (n - 1) for i in range(n)]


FACTORS = tuple(linspace(1.3, 2.5, 10))


def grid_deltas(smaller_side: float) -> list[float]:
    return [10**x for x in linspace(math.log10(smaller_side / 10), math.log10(smaller_side / 2), 8)]


def default_grid(spark, smaller_side: float) -> DataFrame:
    return generators.parameter_grid(spark, grid_deltas(smaller_side), FACTORS, STEPS)


def evaluate(segs: DataFrame, combos: DataFrame, target: float) -> DataFrame:
    """Dimension and score |D - target| of every combination on every curve.

    Ladders with the same start and factor are prefixes of one another, so
    cells are counted once for the longest and the shorter ones read its first
    scales.
    """
    box = curves.bounding_boxes(segs).withColumn("side", F.lit(1.0))
    return _evaluated(segs, box, combos, target)


def _evaluated(segs: DataFrame, box: DataFrame, combos: DataFrame, target: float) -> DataFrame:
    """box: each curve's, with the side of which initial_delta of ``combos`` is a share."""
    ladders = combos.groupBy(F.col("initial_delta").alias("share"), "delta_factor").agg(F.sort_array(F.collect_list(F.struct(F.col("combo_idx").cast("long").alias("combo_idx"), F.col("num_steps").cast("int").alias("num_steps")))).alias("sets"))  # the combinations are a fixed grid
    fit = boxcount.ladder_fits(segs, box, ladders)
    return fit.select("curve_id", "combo_idx", "initial_delta", "delta_factor", "num_steps", F.col("slope").alias("dimension"), F.col("r2").alias("r_squared"), F.abs(F.col("slope") - target).alias("score"))


def own_grid(spark) -> DataFrame:
    """The grid's combinations with their sizes as shares of a curve's smaller side."""
    return generators.parameter_grid(spark, grid_deltas(1.0), FACTORS, STEPS)


def evaluate_own(segs: DataFrame, combos: DataFrame, target: float, smallest: float = 0.0) -> DataFrame:
    """Like ``evaluate``, where each curve has a grid by its own box: initial_delta of ``combos`` is a share of its smaller side.

    Curves of which one side is ``smallest`` or less have no grid.
    """
    side = F.least("width", "height")
    box = curves.bounding_boxes(segs).where(side > smallest).withColumn("side", side)
    return _evaluated(segs, box, combos, target)


def best(scored: DataFrame) -> DataFrame:
    """The first combination with the least score, per curve; none where no combination is valid."""
    first = F.min_by(F.struct("combo_idx", "initial_delta", "delta_factor", "num_steps", "dimension", "r_squared", "score"), F.struct("score", "combo_idx")).alias("b")
    return scored.groupBy("curve_id").agg(first).select("curve_id", "b.*")


def top(scored: DataFrame, k: int = 20) -> DataFrame:
    return scored.orderBy("score", "combo_idx", "curve_id").limit(k)


def top_each(scored: DataFrame, k: int = 20) -> DataFrame:
    """The first k combinations of each curve, of at most as many as the grid has."""
    w = Window.partitionBy("curve_id").orderBy("score", "combo_idx")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def fine_score(scored: DataFrame) -> DataFrame:
    """(combo_idx, s) of one curve's combinations: |D - target| + 10 (1 - r squared)."""
    return scored.select("combo_idx", (F.col("score") + 10 * (1 - F.col("r_squared"))).alias("s"))


def differential_evolution(
    segs: DataFrame, target: float, generations: int = GENERATIONS, people: int = PEOPLE, seed: int = 42, cross: float = 0.7, tolerance: float = TOLERANCE, patience: int = PATIENCE,
    score: Callable[[DataFrame], DataFrame] = fine_score,
) -> DataFrame:
    """One curve's parameters by evolution: (curve_id, initial_delta, delta_factor, num_steps, score, generations).

    A population of ``people`` for each of the three parameters moves between the
    best one and the difference of two others, with a weight that is drawn anew
    each generation. A generation's candidates are one DataFrame and one job;
    only their scores come to the driver. It ends when all scores are as good as
    equal, when ``patience`` generations have brought no better one, or after
    ``generations``. Candidates that are not valid get 1e6. Several curves are an
    error: each needs a search of its own.
    """
    spark = segs.sparkSession
    boxes = curves.bounding_boxes(segs).limit(2).collect()
    if len(boxes) != 1:
        raise ValueError("differential evolution takes the segments of one curve")
    box, n = boxes[0], 3 * people
    m = min(box.width, box.height)
    low, high = np.array([math.log(m / 20), math.log(1.2), 5.0]), np.array([math.log(m / 2), math.log(3.0), 25.0])
    rng = np.random.default_rng(seed)
    # one of the population in each of n equal parts of every parameter's range
    crowd = low + (np.stack([rng.permutation(n) for _ in range(3)], 1) + rng.random((n, 3))) / n * (high - low)
    segs = segs.cache()

    def scores(rows: np.ndarray) -> np.ndarray:
        combos = spark.createDataFrame([(i, float(math.exp(a)), float(math.exp(b)), int(round(c))) for i, (a, b, c) in enumerate(rows)], "combo_idx long, initial_delta double, delta_factor double, num_steps int")
        out = np.full(len(rows), 1e6)
        for r in score(evaluate(segs, combos, target)).collect():
            out[r.combo_idx] = r.s
        return out

    fitness, done, idle = scores(crowd), 0, 0
    while done < generations and idle < patience and fitness.std() > tolerance * (1 + abs(fitness.mean())):
        picks = np.array([rng.permutation(n)[:2] for _ in range(n)])
        mutant = crowd[fitness.argmin()] + rng.uniform(0.5, 1.0) * (crowd[picks[:, 0]] - crowd[picks[:, 1]])
        outside = (mutant < low) | (mutant > high)
        mutant = np.where(outside, low + rng.random((n, 3)) * (high - low), mutant)
        keep = rng.random((n, 3)) < cross
        keep[np.arange(n), rng.integers(0, 3, n)] = True
        trial = np.where(keep, mutant, crowd)
        new = scores(trial)
        idle = 0 if new.min() < fitness.min() - 1e-12 else idle + 1
        better = new <= fitness
        crowd, fitness, done = np.where(better[:, None], trial, crowd), np.where(better, new, fitness), done + 1
    segs.unpersist()
    a, b, c = crowd[fitness.argmin()]
    return spark.createDataFrame([(box.curve_id, math.exp(a), math.exp(b), int(round(c)), float(fitness.min()), done)], "curve_id string, initial_delta double, delta_factor double, num_steps int, score double, generations int")


def evolve(segs: DataFrame, target: float, generations: int = GENERATIONS, people: int = PEOPLE, seed: int = 42, cross: float = 0.7, patience: int = PATIENCE) -> DataFrame:
    """Differential evolution of the parameters of every curve at once: (curve_id, initial_delta, delta_factor, num_steps, score, generations).

    The population is a table of (curve, member) rows: ``people`` members for each of
    the three parameters, at first one in each equal part of every range. A generation's
    trial of a member lies between its curve's best and the difference of two others,
    which are named by hashes of (curve, member, generation), as are all random
    numbers, so that a task that is run again makes the same trials. All trials of all
    curves are one job of box counts, the better of trial and member stays, and the
    best is an aggregate. Nothing but the number of curves that still move comes to the
    driver: a curve rests after ``patience`` generations without a better best.
    A trial that is not valid scores 1e6. Curves without a smaller side have no row.
    """
    n = 3 * people
    box = spread.written(curves.bounding_boxes(segs).where("least(width, height) > 0").select("curve_id", "xmin", "xmax", "ymin", "ymax", F.least("width", "height").alias("side")))
    genes = {"a": (math.log(1 / 20), math.log(1 / 2)), "b": (math.log(1.2), math.log(3.0)), "c": (5.0, 25.0)}

    def drawn(*what: Column | int) -> Column:
        """A number from 0 to 1 for each curve, member and ``what``."""
        return F.pmod(F.xxhash64("curve_id", "member", F.lit(seed), *[F.lit(w) if isinstance(w, int) else w for w in what]), F.lit(1 << 40)) / float(1 << 40)

    def scored(crowd: DataFrame) -> DataFrame:
        sets = crowd.join(box, "curve_id").select(
            "curve_id", "member", "xmin", "xmax", "ymin", "ymax", (F.exp("a") * F.col("side")).alias("initial_delta"), F.exp("b").alias("delta_factor"), F.round("c").cast("int").alias("num_steps")
        )
        found = boxcount.dimensions(segs, sets, keys=("member",)).where("valid").select("curve_id", "member", (F.abs(F.col("dimension") - target) + 10 * (1 - F.col("r_squared"))).alias("s"))
        return crowd.join(found, ["curve_id", "member"], "left").withColumn("s", F.coalesce("s", F.lit(1e6)))

    crowd = box.select("curve_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("member"))
    for k, (gene, (low, high)) in enumerate(genes.items()):
        part = F.row_number().over(Window.partitionBy("curve_id").orderBy(drawn(-1, k), "member")) - 1  # of a curve's n members
        crowd = crowd.withColumn(gene, low + (part + drawn(-2, k)) / n * (high - low))
    crowd = spread.written(scored(crowd).withColumns({"idle": F.lit(0), "done": F.lit(0)}))
    for g in range(generations):
        moving = crowd.where(F.col("idle") < patience)
        if moving.isEmpty():
            break
        lead = F.min_by(F.struct("a", "b", "c", "s"), F.struct("s", "member"))
        leaders = moving.groupBy("curve_id").agg(lead.alias("lead")).select("curve_id", *[F.col(f"lead.{x}").alias(f"{x}0") for x in (*genes, "s")])
        first = F.floor(drawn(g, 10) * n).cast("int")
        picks = moving.join(leaders, "curve_id").withColumns({"p": first, "q": F.pmod(first + 1 + F.floor(drawn(g, 11) * (n - 1)).cast("int"), F.lit(n))})
        for name in ("p", "q"):
            other = moving.select("curve_id", F.col("member").alias(name), *[F.col(x).alias(f"{x}_{name}") for x in genes])
            picks = picks.join(other, ["curve_id", name])
        weight = 0.5 + 0.5 * F.pmod(F.xxhash64("curve_id", F.lit(seed), F.lit(g)), F.lit(1 << 40)) / float(1 << 40)
        forced = F.floor(drawn(g, 12) * 3)
        trial = picks
        for k, (gene, (low, high)) in enumerate(genes.items()):
            mutant = F.col(f"{gene}0") + weight * (F.col(f"{gene}_p") - F.col(f"{gene}_q"))
            mutant = F.when(mutant.between(low, high), mutant).otherwise(low + drawn(g, 20 + k) * (high - low))
            trial = trial.withColumn(f"{gene}_t", F.when((drawn(g, 30 + k) < cross) | (forced == k), mutant).otherwise(F.col(gene)))
        trial = spread.written(trial.select("curve_id", "member", *[F.col(f"{x}_t").alias(x) for x in genes], *[F.col(x).alias(f"{x}_old") for x in (*genes, "s")], "s0", "idle"))
        both = scored(trial)
        better = F.col("s") <= F.col("s_old")
        kept = both.select("curve_id", "member", *[F.when(better, F.col(x)).otherwise(F.col(f"{x}_old")).alias(x) for x in (*genes, "s")], "s0", "idle")
        kept = spread.written(kept)
        progress = kept.groupBy("curve_id").agg(F.when(F.min("s") < F.min("s0") - 1e-12, 0).otherwise(F.max("idle") + 1).alias("now"))
        kept = kept.join(progress, "curve_id").select("curve_id", "member", *genes, "s", F.col("now").alias("idle"), F.lit(g + 1).alias("done"))
        crowd = spread.written(kept.unionByName(crowd.where(F.col("idle") >= patience)))
    winner = crowd.groupBy("curve_id").agg(F.min_by(F.struct(*genes, "s", "done"), F.struct("s", "member")).alias("w"))
    out = winner.join(box.select("curve_id", "side"), "curve_id")
    return out.select("curve_id", (F.exp("w.a") * F.col("side")).alias("initial_delta"), F.exp("w.b").alias("delta_factor"), F.round("w.c").cast("int").alias("num_steps"), F.col("w.s").alias("score"), F.col("w.done").alias("generations"))
