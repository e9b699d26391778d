"""Searches of many curves, nested cells and curves by their digits, against SQL and plain versions."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import rows

from coastline.catalog import generator_queries
from coastline.catalog.tables import rounded
from coastline.operators import boxcount, contour, curves, generators, search
from coastline.plans import studies


def test_grid_of_every_event_curve_equals_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet' WHERE user_id % 5 = 0")
    df = generator_queries.QUERIES["grid_search_events"](spark, data)
    df = df.where("cast(curve_id as long) % 5 = 0")
    want = con.sql(generator_queries.GRID_SEARCH_SQL)
    assert rows(df.columns, df.collect()) == rows([*want.columns], want.fetchall())


def test_nested_counts_are_those_of_each_size(spark):
    segs = generators.addressed_koch(spark.sql("select 'k' as curve_id, 3 as level"), 3).unionByName(generators.addressed_hilbert(spark.sql("select 'h' as curve_id, 3 as level")))
    got = {(r.curve_id, r.k): (round(r.delta, 12), r.n_boxes) for r in boxcount.nested_counts(segs, 7).collect()}
    params = curves.bounding_boxes(segs).withColumns({"initial_delta": F.greatest("width", "height") / 2, "delta_factor": F.lit(2.0), "num_steps": F.lit(7)})
    want = {(r.curve_id, r.k): (round(r.delta, 12), r.n_boxes) for r in boxcount.occupied(segs, boxcount.ladder(params)).groupBy("curve_id", "k", "delta").agg(F.count(F.lit(1)).alias("n_boxes")).collect()}
    assert got == want and len(got) == 14


def test_spans_count_what_cells_count(spark):
    """Steep, flat, upright and single-point segments, and ends on the edges of cells."""
    points = [(0, 0), (1, 8), (1, 2), (4, 2), (4, 4), (4, 4), (7.5, 0.25), (2, 6), (6, 6), (8, 8), (0.1, 7.9)]
    segs = spark.createDataFrame([("c", i, *map(float, a + b)) for i, (a, b) in enumerate(zip(points, points[1:], strict=False))], "curve_id string, seg_idx long, x1 double, y1 double, x2 double, y2 double")
    params = curves.bounding_boxes(segs).withColumns({"initial_delta": F.lit(4.0), "delta_factor": F.lit(2.0), "num_steps": F.lit(6)})
    for factor in (2.0, 1.3):
        scales = boxcount.ladder(params.withColumn("delta_factor", F.lit(factor)))
        got = {r.k: r.n_boxes for r in boxcount.box_counts(segs, scales).collect()}
        assert got == {r.k: r.n for r in boxcount.occupied(segs, scales).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_evolution_of_many_curves_is_no_worse_than_their_grids(spark):
    segs = generators.addressed_koch(spark.sql("select explode(array('a', 'b')) as curve_id, 2 as level"), 2).withColumns({c: F.when(F.col("curve_id") == "b", F.col(c) * 50).otherwise(F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    flat = spark.sql("select 'flat' as curve_id, 0L as seg_idx, 0D as x1, 0D as y1, 1D as x2, 0D as y2")
    grid = generators.parameter_grid(spark, search.grid_deltas(1.0)[::3], search.FACTORS[::3], search.STEPS[::3])
    scored = search.evaluate_own(segs, grid, 1.2618595)
    best = {r.curve_id: r.s for r in scored.groupBy("curve_id").agg(F.min(F.col("score") + 10 * (1 - F.col("r_squared"))).alias("s")).collect()}
    found = {r.curve_id: r for r in search.evolve(segs.unionByName(flat), 1.2618595, generations=6, people=6, patience=4).collect()}
    assert set(found) == {"a", "b"}
    for k, r in found.items():
        assert r.score <= best[k] + 0.02 and 5 <= r.num_steps <= 25 and 1.2 <= r.delta_factor <= 3
        assert r.generations <= 6


@pytest.mark.parametrize("name", sorted(generators.SYSTEMS))
def test_segments_by_their_digits_are_the_turtles(spark, name, monkeypatch):
    monkeypatch.setattr(generators, "STRETCH", 7)
    got = generators.addressed(spark.createDataFrame([("a", 0), ("b", 2), ("c", 3)], "curve_id string, level int"), name, 3)
    for curve, level in (("a", 0), ("b", 2), ("c", 3)):
        want = [(r.seg_idx, *[pytest.approx(v, abs=1e-9) for v in (r.x1, r.y1, r.x2, r.y2)]) for r in generators.lsystem(spark, name, level).orderBy("seg_idx").collect()]
        assert [tuple(r) for r in got.where(F.col("curve_id") == curve).orderBy("seg_idx").drop("curve_id").collect()] == want


@pytest.mark.parametrize("copied", [0, 20, 1 << 14])
def test_levels_are_made_once_and_curves_dealt_over_all_tasks(spark, monkeypatch, copied):
    """Curves copied from the table of levels are those made from their numbers, and few bytes of curves don't end up in one task."""
    of = spark.range(40).selectExpr("cast(id as string) as curve_id", "cast(id % 4 as int) as level")
    direct = generators.addressed_hilbert(of)
    monkeypatch.setattr(generators, "COPIED", copied)
    got = generators.addressed_hilbert(of, 3)
    assert got.exceptAll(direct).count() == direct.exceptAll(got).count() == 0 < got.count()
    koch = generators.addressed_koch(of, 3)
    for r in koch.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.max("x2").alias("x"), F.max("seg_idx").alias("last")).collect():
        assert r.n == 4 ** (int(r.curve_id) % 4) == r.last + 1 and r.x == pytest.approx(3)
    assert all(df.select(F.spark_partition_id()).distinct().count() > 2 for df in (got, koch))
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        generators.addressed_koch(of, 2).count()


def test_contours_beside_missing_nodes_and_frames_without_one(spark):
    nodes = [(1.0, i, j, float(i), float(j), float(i + j) / 6) for i in range(4) for j in range(4) if (i, j) != (1, 1)]
    nodes += [(2.0, i, j, float(i), float(j), 0.0) for i in range(3) for j in range(3)]
    field = spark.createDataFrame(nodes, "time double, ix int, iy int, x double, y double, f double")
    got = {r.time: (r.n_segments, r.length) for r in contour.by_frame(field, 0.5).collect()}
    segs = contour.contours(field, 0.5).collect()
    assert got[2.0] == (0, 0.0) and got[1.0][0] == len(segs) > 0
    assert all(abs(v - 3) < 1e-9 for s in segs for v in (s.x1 + s.y1, s.x2 + s.y2))
    assert not any(0 < s.x1 < 2 and 0 < s.y1 < 2 and 0 < s.x2 < 2 and 0 < s.y2 < 2 for s in segs)  # no cell has the missing corner
    rows = {r.time: r for r in studies.evolution(field, applied=False).collect()}
    assert rows[2.0].n_segments == 0 and rows[2.0].dimension is None and rows[1.0].n_segments == len(segs)


def test_counts_of_curves_in_pieces(spark, monkeypatch):
    """A curve of more segments than a piece, turned by angles as well; its counts are those of testing each cell."""
    segs = generators.addressed_hilbert(spark.sql("select explode(array('a', 'b')) as curve_id, 3 as level")).unionByName(generators.addressed_koch(spark.sql("select 'k' as curve_id, 1 as level"), 1))
    scales = boxcount.ladder(curves.expanded(curves.bounding_boxes(segs)).withColumns({"initial_delta": F.lit(0.4), "delta_factor": F.lit(1.7), "num_steps": F.lit(4)})).select("curve_id", "k", "delta", "xmin", "xmax", "ymin", "ymax")
    many = segs.crossJoin(spark.range(3).select(F.col("id").alias("angle")))
    many = curves.rotated(many, F.col("angle") * 20.0, curves.centres(curves.bounding_boxes(segs)))
    want = {tuple(r) for r in boxcount.occupied(many, scales, keys=("angle", "k")).groupBy("curve_id", "k", "angle").agg(F.count(F.lit(1))).collect()}
    for stretch in (1 << 14, 5):
        monkeypatch.setattr(boxcount, "STRETCH", stretch)
        got = boxcount.box_counts(many, scales, keys=("k", "angle")).select("curve_id", "k", "angle", "n_boxes")
        assert {tuple(r) for r in got.collect()} == want and len(want) == 36


def test_counts_where_rounding_decides(spark):
    """Heights at a column's side that are the edge of two rows but for rounding: the test of each cell decides."""
    segs = spark.createDataFrame([("a", 35, 36.0, 59.04, 37.0, 6.94), ("b", 29, 30.0, 115.68, 31.0, 8.38)], "curve_id string, seg_idx long, x1 double, y1 double, x2 double, y2 double")
    grids = spark.createDataFrame([("a", 0, 0.875, 1.0, 57.0, 1.69, 386.13), ("b", 0, 1.0, 1.0, 65.0, 1.38, 297.0)], "curve_id string, k int, delta double, xmin double, xmax double, ymin double, ymax double")
    assert {r.curve_id: r.n_boxes for r in boxcount.box_counts(segs, grids).collect()} == {"a": 62, "b": 110}


def test_rounded_is_the_sqls(spark):
    values = [2.0959375, 0.8646875, 1.4403125, 4.0715625, -2.0959375, 0.1234565, 1e300, 1.5e308, float("nan"), 12345678.1234565]
    got = [r[0] for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).orderBy("i").select("v").collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    assert [repr(v) for v in got] == [repr(v) for v in want]
