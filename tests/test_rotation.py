"""Curves turned in the tasks that count them: counts of each cell's test, one pass, and no rows made for angles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coastline.operators import boxcount, curves, generators, rotation, search, spans


@pytest.fixture(scope="module")
def segs(spark):
    return generators.addressed_hilbert(spark.sql("select explode(array('a', 'b')) as curve_id, 2 as level")).unionByName(
        generators.addressed_koch(spark.sql("select 'k' as curve_id, 1 as level"), 1)
    ).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_by_angle_are_those_of_each_cell(spark, segs, monkeypatch):
    angles = (0.0, 20.0, 90.0)
    scales = rotation.default_scales(segs, 3, 12, 1.7)
    many = segs.select("*", F.posexplode(F.array(*[F.lit(a) for a in angles])).alias("angle_idx", "rotation"))
    many = curves.rotated(many, "rotation", curves.centres(curves.bounding_boxes(segs)))
    want = {tuple(r) for r in boxcount.occupied(many, scales, keys=("angle_idx", "k")).groupBy("curve_id", "angle_idx", "k").agg(F.count(F.lit(1))).collect()}
    for stretch in (1 << 14, 6):  # and in pieces
        monkeypatch.setattr(boxcount, "STRETCH", stretch)
        for given in (scales, scales.select("curve_id", "k", "delta")):
            got = rotation.counts_by_angle(segs, given, angles).select("curve_id", "angle_idx", "k", "n_boxes")
            assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_comparison_counts_once(segs):
    """The dimension at no rotation and that of the least counts come from one pass over the counts."""
    assert plan(rotation.compare(segs)).count("FlatMapCoGroupsInArrow") == 1


def test_many_curves_share_a_call(spark, monkeypatch):
    """Short curves meet their sizes in common groups: not as many calls as curves."""
    segs = generators.addressed_koch(spark.sql("select cast(id as string) as curve_id, 1 as level from range(200)"), 1)
    counts = boxcount.box_counts(segs, boxcount.ladder(curves.bounding_boxes(segs).withColumns({"initial_delta": F.lit(0.5), "delta_factor": F.lit(2.0), "num_steps": F.lit(3)})))
    assert "[_group" in plan(counts) and counts.count() == 600
    assert {tuple(r) for r in counts.groupBy("k").agg(F.min("n_boxes") == F.max("n_boxes")).collect()} == {(0, True), (1, True), (2, True)}


def test_batches_of_spans_count_alike(monkeypatch):
    """Many bodies and grids at once, in batches of any size, and a unit larger than a batch."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (60, 4)).astype(float)
    segs, start, length = tuple(x.T), np.array([0, 7, 8, 30]), np.array([7, 1, 22, 30])
    delta = np.array([4.0, 1.0, 0.3, 0.125])
    grids = (delta, np.zeros(4), np.full(4, 8.0), np.array([0.0, 0.5, 0.0, 0.0]), np.full(4, 8.0))
    body, grid = (c.ravel() for c in np.meshgrid(range(4), range(4)))
    want = np.zeros(16, int)
    for u, (b, g) in enumerate(zip(body, grid)):
        i, j = (c.ravel() for c in np.meshgrid(np.arange(np.ceil(8 / delta[g])), np.arange(np.ceil((8 - grids[3][g]) / delta[g]))))
        met = np.zeros(len(i), bool)
        for s in range(start[b], start[b] + length[b]):
            met |= spans._meets(*[np.full(len(i), c[s]) for c in segs], i * delta[g], (i + 1) * delta[g], grids[3][g] + j * delta[g], grids[3][g] + (j + 1) * delta[g])
        want[u] = met.sum()
    for pairs, batch in ((1 << 12, 1 << 15), (9, 50), (200, 7)):
        monkeypatch.setattr(spans, "PAIRS", pairs)
        monkeypatch.setattr(spans, "BATCH", batch)
        assert spans.counted(segs, start, length, grids, body, grid).tolist() == want.tolist()


def test_fits_of_a_grid_stay_in_the_tasks_that_count(spark, monkeypatch):
    """No table of counts is joined to the combinations; a curve in pieces, whose counts are, has the same fits."""
    segs = generators.addressed_koch(spark.sql("select explode(array('a', 'b')) as curve_id, 2 as level"), 2).withColumns({c: F.when(F.col("curve_id") == "b", F.col(c) * 7).otherwise(F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    grid = generators.parameter_grid(spark, [*search.grid_deltas(1.0)[::3], 1.5], search.FACTORS[::3], search.STEPS[::2])
    found = {}
    for stretch in (1 << 14, 5):
        monkeypatch.setattr(boxcount, "STRETCH", stretch)
        scored = search.evaluate_own(segs, grid, 1.2618595)
        if stretch > 5:
            assert plan(scored).count("FlatMapCoGroupsInArrow") == 1 and "SortMergeJoin" not in plan(scored) and "BroadcastHashJoin" not in plan(scored)
        found[stretch] = {(r.curve_id, r.combo_idx, r.num_steps): (r.initial_delta, r.delta_factor, r.dimension, r.r_squared) for r in scored.collect()}
    assert found[5].keys() == found[1 << 14].keys() and len(found[5]) > 20
    for k, v in found[5].items():
        assert found[1 << 14][k] == pytest.approx(v, rel=1e-9)


def test_of_angles_as_good_as_equal_the_first_is_the_least(spark):
    """Angles with the same counts tie, in whatever order their rows are added up."""
    rows = spark.range(300).selectExpr("cast(id as string) as curve_id", "explode(sequence(0, 7)) as k").selectExpr("*", "1D / (5 * pow(1.5D, k)) as delta", "cast(5 * pow(1.5D, k) + pmod(hash(curve_id, k), 4) as bigint) as n_boxes")
    counts = rows.select("*", F.posexplode(F.array(*[F.lit(a) for a in (0.0, 55.0, 60.0)])).alias("angle_idx", "rotation")).withColumn("n_boxes", F.when(F.col("angle_idx") == 0, F.expr("n_boxes * (k + 1)")).otherwise(F.col("n_boxes")))
    found = rotation.over_angles(counts.repartition(7, F.hash("curve_id", "k", "rotation")))
    assert {r.min_angle for r in found.collect()} == {55.0}


def test_scales_and_domains_come_from_one_pass_over_boxes(spark, segs):
    """Neither domains nor centres are joined to scales or to segments."""
    assert "Join" not in plan(rotation.rotation_dimension(spark.createDataFrame(segs.collect(), segs.schema)))


def test_least_counts_need_no_sorting(spark, segs):
    own = spark.createDataFrame(segs.collect(), segs.schema)
    least = rotation.least_counts(rotation.counts_by_angle(own, rotation.default_scales(own)))
    assert "SortAggregate" not in plan(least)
    counts = spark.createDataFrame([("c", 0, 0.5, i, a, n) for i, (a, n) in enumerate(((0.0, 9), (45.0, 7), (90.0, 7)))], "curve_id string, k int, delta double, angle_idx int, rotation double, n_boxes long")
    assert [tuple(r) for r in rotation.least_counts(counts, (0.0, 45.0, 90.0)).collect()] == [("c", 0, 0.5, 7, 45.0, 9, 9)]
