"""Ordered work over chunks of a key: the same rows as over the whole key, and a hot key over many groups."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from coastline.catalog import curve_queries
from coastline.catalog.tables import event_curves
from coastline.operators import boxcount, curvature, curves, quantiles, selfsim, spread
from coastline.plans import comprehensive


@pytest.fixture(scope="module")
def hot(spark):
    """One series with a third of all rows, short ones beside it."""
    df = spark.range(900).selectExpr("if(id % 3 = 0, 'hot', concat('s', id % 40)) as series_id", "xxhash64(id) as t", "sin(id * 0.7D) + (xxhash64(id, 5) % 1000) / 2000D as value")
    return df.unionByName(spark.sql("select cast(null as string) as series_id, 1L as t, 0D as value"))


@pytest.fixture(scope="module")
def signal(hot):
    return spread.numbered(hot, "series_id", ["t"], "idx").select("series_id", "idx", "value").cache()


def close(a, b):
    assert set(a) == set(b)
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9), k


def keyed(df, *keys):
    rest = [c for c in df.columns if c not in keys]
    return {tuple(r[k] for k in keys): [r[c] for c in rest] for r in df.collect()}


def test_numbers_are_those_of_a_window(hot, spark):
    want = hot.where("series_id is not null").withColumn("pos", (F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1).cast("long"))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert sorted(spread.numbered(hot, "series_id", ["t"]).select(*want.columns).collect()) == sorted(want.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread.numbered(hot.limit(0), "series_id", ["t"]).count() == 0


@pytest.mark.parametrize("length", [7, 5000])
def test_running_sums_over_levels_of_chunks(signal, length):
    w = Window.partitionBy("series_id").orderBy("idx")
    want = signal.withColumns({"up": F.sum("value").over(w), "n": F.count("value").over(w)})
    got = spread.running_sums(signal, "series_id", "idx", {"up": F.col("value"), "n": F.lit(1)}, length)
    close(keyed(got, "series_id", "idx"), keyed(want, "series_id", "idx"))
    down = Window.partitionBy("series_id").orderBy(F.desc("idx"))
    got = spread.running_sums(signal, "series_id", "idx", {"down": F.col("value")}, length, backwards=True)
    close(keyed(got, "series_id", "idx"), keyed(signal.withColumn("down", F.sum("value").over(down)), "series_id", "idx"))


def test_halos_show_what_a_whole_window_shows(signal):
    def kernel(df, w):
        return df.withColumns({"before": F.lag("value", 3).over(w), "after": F.lead("value", 2).over(w)})

    want = kernel(signal, Window.partitionBy("series_id").orderBy("idx"))
    got = spread.in_chunks(signal, "series_id", "idx", 3, 2, kernel, 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("kernel", [selfsim.hurst, lambda s: selfsim.scaling_range(s), lambda s: selfsim.structure_function(s, 3, 100).select("series_id", "lag", "n", "value")])
def test_self_similarity_is_the_same_in_chunks(signal, monkeypatch, kernel):
    want = kernel(signal)
    keys = [c for c in ("series_id", "lag") if c in want.columns]
    want = keyed(want.fillna(-1), *keys)
    monkeypatch.setattr(spread, "CHUNK", 16)
    close(keyed(kernel(signal).fillna(-1), *keys), want)


def test_curvature_is_the_same_in_chunks_and_by_ranges(signal, monkeypatch):
    segs = curves.segments_from_points(signal.select(F.col("series_id").alias("curve_id"), F.col("idx").alias("pos"), F.col("idx").cast("double").alias("x"), F.col("value").alias("y")))
    points = curvature.unique_points(segs)
    want = {k: keyed(f(points), "curve_id", "pos") for k, f in curvature.METHODS.items()}
    features = keyed(curvature.features(segs).drop("curvature_percentiles").fillna(0), "curve_id")
    monkeypatch.setattr(spread, "CHUNK", 8)
    for k, f in curvature.METHODS.items():
        close(keyed(f(points), "curve_id", "pos"), want[k])
    close(keyed(curvature.features(segs, ranged=True).drop("curvature_percentiles").fillna(0), "curve_id"), features)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(size=500).round(1), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "same": np.full(9, 0.1)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None), (None, 1.0)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.quantiles) for r in quantiles.exact(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in groups.items()}
    for k, (_, q) in got.items():
        assert q == pytest.approx(np.quantile(groups[k], shares))
    assert got["same"][1] == [0.1] * 6
    assert quantiles.exact(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact(spark.createDataFrame([], "g string, v double"), "g", "v", [1.5])


def test_a_hot_key_is_many_groups(signal):
    """No chunk has more rows than its length and the halo, whatever share of the rows its key has."""
    sizes = spread.haloed(signal, "idx", 2, 2, 16).groupBy("series_id", "chunk").count()
    assert sizes.where("series_id = 'hot'").count() == -(-300 // 16) and sizes.agg(F.max("count")).first()[0] <= 20


def test_partitions_of_curves_and_counts_grow_with_the_rows(spark, data, monkeypatch):
    """Tables of any size in partitions of about ``ROWS`` rows, a curve in one of them, and the same counts."""

    def found():
        segs = event_curves(spark, data)
        return segs, boxcount.box_counts(segs, boxcount.ladder(curve_queries.quarter_params(segs)), gathered=True)

    want = {tuple(r) for r in found()[1].select("curve_id", "k", "n_boxes").collect()}
    monkeypatch.setattr(spread, "ROWS", 100)
    segs, counts = found()
    assert {tuple(r) for r in counts.select("curve_id", "k", "n_boxes").collect()} == want
    for df in (segs, counts):
        at = df.select("curve_id", F.spark_partition_id().alias("p"))
        assert at.select("p").distinct().count() > 4 and at.distinct().count() == at.select("curve_id").distinct().count()


def test_no_task_has_the_work_of_several_methods(spark, data, capsys):
    """What the consensus reads are written rows, one a curve and method: its tasks hold no method's sorts."""
    rows = comprehensive.method_rows(event_curves(spark, data))
    rows.explain()
    plan = capsys.readouterr().out
    assert "Union" in plan and "Window" not in plan and "Aggregate" not in plan
    assert {r.n for r in rows.groupBy("curve_id").agg(F.countDistinct("method").alias("n")).collect()} == {5}
