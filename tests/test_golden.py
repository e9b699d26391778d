"""Published and derived values on generated curves, and properties that must hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coastline.operators import boxcount, consensus, convergence, curvature, curves, features, feedback, generators, rules, search, selfsim, spectrum, temporal
from coastline.plans import studies


def box_dimension(segs, delta, factor, steps, domain=None):
    box = curves.bounding_boxes(segs)
    if domain:
        box = box.withColumns({k: F.lit(v) for k, v in zip(("xmin", "xmax", "ymin", "ymax"), domain, strict=True)})
    return boxcount.dimensions(segs, box.withColumns({"initial_delta": F.lit(delta), "delta_factor": F.lit(factor), "num_steps": F.lit(steps)})).first()


def test_koch_box_counts(spark):
    segs = generators.koch(spark, 2)
    box = curves.bounding_boxes(segs).withColumns({"initial_delta": F.lit(0.5), "delta_factor": F.lit(1.5), "num_steps": F.lit(10)})
    counts = [r.n_boxes for r in boxcount.box_counts(segs, boxcount.ladder(box)).orderBy("k").collect()]
    assert all(abs(a - b) <= 2 for a, b in zip(counts, [9, 13, 25, 37, 60, 94, 145, 218, 331, 499], strict=True))
    got = box_dimension(segs, 0.5, 1.5, 10)
    # the curve lies on the grid: its first two counts depend on the last bit of the peaks' heights
    assert got.valid and (got.dimension == pytest.approx(1.108687, abs=2e-3) or got.dimension == pytest.approx(1.086760, abs=2e-3))


def test_line_in_a_padded_domain(spark):
    segs = generators.line(spark, 10, 5.0).withColumns({"y1": F.lit(2.5), "y2": F.lit(2.5)})
    assert box_dimension(segs, 0.5, 1.8, 15).reason == "initial_delta_too_large"
    got = box_dimension(segs, 0.2, 1.2, 15, (0.0, 5.0, 2.4, 2.6))
    assert got.dimension == pytest.approx(0.998349, abs=1e-3)


def test_dragon_is_gated(spark):
    segs = generators.lsystem(spark, "dragon_lsystem", 3)
    assert box_dimension(segs, 0.8, 1.5, 20).reason == "delta_too_small"


@pytest.mark.parametrize(
    ("make", "n", "dcr", "tortuosity", "kind"),
    [
        (lambda s: generators.line(s, 10, 5.0), 10, 0.0, 1.0, "straight_line"),
        (lambda s: generators.koch(s, 1), 4, 0.75, 4 / 3, "koch_curve"),
        (lambda s: generators.koch(s, 3), 64, 0.984375, 64 / 27, "koch_curve"),
        (lambda s: generators.koch(s, 4), 256, 0.996094, 256 / 81, "high_turning_fractal"),
        (lambda s: generators.lsystem(s, "minkowski", 1), 8, 0.75, 2.0, "koch_curve"),
        (lambda s: generators.lsystem(s, "sierpinski", 2), 27, 2 / 3, 6.75, "koch_curve"),
        (lambda s: generators.hilbert(s, 2), 15, 0.8, 5.0, "high_turning_fractal"),
    ],
)
def test_features_and_classes(spark, make, n, dcr, tortuosity, kind):
    row = rules.classify(features.features(make(spark))).first()
    assert row.n_segments == n
    assert row.direction_change_rate == pytest.approx(dcr, abs=1e-6)
    assert row.tortuosity == pytest.approx(tortuosity, abs=1e-6)
    assert row.interface_type == kind


def test_candidates_equal_brute_force(spark):
    """All cells against the candidates, on random segments."""
    rng = np.random.default_rng(1)
    pts = np.round(rng.random((40, 4)) * 4, 3).tolist()
    segs = spark.createDataFrame([("r", i, *p) for i, p in enumerate(pts)], "curve_id string, seg_idx long, x1 double, y1 double, x2 double, y2 double")
    domain = spark.createDataFrame([("r", 0, 0.3, 0.0, 4.0, 0.0, 4.0)], "curve_id string, k int, delta double, xmin double, xmax double, ymin double, ymax double")
    found = {(r.i, r.j) for r in boxcount.occupied(segs, domain).collect()}

    def meets(s, a, b, c, d):
        x1, y1, x2, y2 = s
        if (x1 < a and x2 < a) or (x1 > b and x2 > b) or (y1 < c and y2 < c) or (y1 > d and y2 > d):
            return False
        t = np.linspace(0, 1, 4001)
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        return bool(((x >= a) & (x <= b) & (y >= c) & (y <= d)).any())

    n = math.ceil(4 / 0.3)
    brute = {(i, j) for i in range(n) for j in range(n) for s in pts if meets(s, i * 0.3, (i + 1) * 0.3, j * 0.3, (j + 1) * 0.3)}
    assert brute <= found
    assert len(found - brute) <= 6  # corners that the sampled brute force steps over


def test_features_do_not_depend_on_place(spark):
    segs = generators.koch(spark, 2)
    moved = segs.withColumns({c: F.col(c) + 7.25 for c in ("x1", "y1", "x2", "y2")})
    a, b = features.features(segs).first(), features.features(moved).first()
    for name in ("tortuosity", "direction_change_rate", "total_length", "bbox_area", "density"):
        assert a[name] == pytest.approx(b[name], rel=1e-9)


def test_hurst_golden(spark):
    rows = [("s", t, math.sin(0.1 * t) + 0.5 * math.sin(0.37 * t)) for t in range(256)]
    got = selfsim.hurst(spark.createDataFrame(rows, "series_id string, idx long, value double")).first()
    assert got.hurst_sf == pytest.approx(0.440113742, abs=1e-6) and got.r2_sf == pytest.approx(0.776155775, abs=1e-6)
    assert got.hurst_va == pytest.approx(0.567774313, abs=1e-6)
    assert got.hurst_dfa == pytest.approx(1.576332380, abs=1e-6)
    assert got.hurst_confidence == pytest.approx(1 / 3)


RUNS = [
    ([475, 2624, 3412, 4116, 4755, 5435], 0.3975, [15, 15, 17, 18, 19, 20], [1.4, 1.4, 1.5, 1.5, 1.5, 1.5]),
    ([6115, 6929, 8079, 8933, 9791, 10177, 11164, 12229, 13027], 0.4009572148125369, [15, 15, 16, 17, 18, 18, 18, 18, 18], [1.4] * 9),
    ([475, 502, 554], 0.3975, [15, 15, 15], [1.4] * 3),
]


@pytest.mark.parametrize(("sizes", "scale", "steps", "factors"), RUNS)
def test_recurrence_golden(spark, sizes, scale, steps, factors):
    frames = spark.createDataFrame([("a", float(t), n, scale) for t, n in enumerate(sizes)], "series_id string, time double, n_segments long, domain_scale double")
    got = temporal.recurrence(frames).orderBy("time").collect()
    assert got[0].initial_delta == pytest.approx(scale / 200)
    assert [r.num_steps for r in got] == steps
    assert [r.delta_factor for r in got] == pytest.approx(factors)


def test_consensus_is_within_its_inputs(spark):
    rows = [("a", "spectrum", 0.1, 1.2, 10.0, 0.5), ("a", "wavelet", 0.3, 1.8, 20.0, 0.9), ("a", "curvature", float("nan"), 1.5, 12.0, 1.0), ("b", "spectrum", 0.1, 1.2, 10.0, 0.0)]
    got = {r.curve_id: r for r in consensus.consensus(spark.createDataFrame(rows, "curve_id string, method string, initial_delta double, delta_factor double, num_steps double, confidence double")).collect()}
    assert got["a"].n_methods == 2 and 0.1 < got["a"].initial_delta < 0.3 and got["a"].confidence == pytest.approx(0.7)
    assert got["b"].n_methods == 0 and got["b"].initial_delta == 0.01 and got["b"].num_steps == 12


def test_welch_finds_a_tone_and_keeps_power():
    t = np.arange(1024) / 64
    h = np.sin(2 * np.pi * 5 * t)
    f, p = spectrum.density(h, 1 / 64)
    assert f[p.argmax()] == pytest.approx(5.0, abs=0.2)
    assert (p.sum() * (f[1] - f[0])) == pytest.approx(0.5, rel=0.05)
    for method in ("periodogram", "multitaper"):
        f, p = spectrum.density(h, 1 / 64, method)
        assert f[p.argmax()] == pytest.approx(5.0, abs=0.3)


def test_circle_has_constant_curvature(spark):
    a = np.linspace(0.3, 2.8, 40)
    pts = [("c", i, -2 * math.cos(v), 2 * math.sin(v)) for i, v in enumerate(a)]
    df = spark.createDataFrame(pts, "curve_id string, pos long, x double, y double")
    for f in (curvature.three_point, curvature.circle_fit):
        assert [r.curvature for r in f(df).collect()] == pytest.approx([0.5] * 40, abs=1e-6)


def test_evolution_is_no_worse_than_the_grid(spark):
    segs = generators.koch(spark, 2)
    target = 1.2618595
    side = curves.bounding_boxes(segs).first().height
    grid = search.fine_score(search.evaluate(segs, search.default_grid(spark, side), target)).agg(F.min("s")).first()[0]
    got = search.differential_evolution(segs, target).first()
    assert got.score <= grid + 1e-3 and got.generations >= 10
    with pytest.raises(ValueError):
        search.differential_evolution(segs.unionByName(generators.hilbert(spark, 2)), target)


def test_transform_is_a_circular_correlation():
    """Against the plain sum, with wavelets shorter and longer than the signal, and a given wavelet."""
    rng = np.random.default_rng(2)
    z, scales = rng.standard_normal(24), np.array([0.1, 1.0, 2.5, 6.0])
    for wavelet in (spectrum.morlet, lambda t: np.exp(-(t**2)) * (1 - t**2) + 0j):
        got = spectrum.transform(z, scales, wavelet)
        for row, s in zip(got, scales, strict=True):
            w = wavelet(np.arange(-3 * s, 3 * s, 1.0) / s) / np.sqrt(s)
            if len(w) > 24:
                w = w[len(w) // 2 - 12 :][:24]
            else:
                before = (24 - len(w)) // 2
                w = np.concatenate([np.zeros(before), w, np.zeros(24 - len(w) - before)])
            g = np.conj(w[::-1])
            assert row == pytest.approx(np.array([sum(z[j] * g[(m - j) % 24] for j in range(24)) for m in range(24)]))


def test_peaks_and_their_fallback():
    assert spectrum.peaks(np.array([0, 1, 0, 2, 2, 2, 0, 3.0, 3.0, 1, 5]), 0.5) == [1, 4, 7]
    assert spectrum.peaks(np.array([0, 0.04, 0]), 0.05) == [] and spectrum.peaks(np.array([2, 2, 1.0]), 0) == []
    row = spectrum.wavelet_row(np.linspace(0, 1, 64), 1.0)
    assert len(row["dominant_scales"]) >= 1 and 0 <= row["energy_concentration"] + 1 <= 2 and sum(row["energy_distribution"]) == pytest.approx(1)


def test_p_values(spark):
    """Against an integral of the t distribution's density."""

    def plain(r, n, steps=20_000):
        if abs(r) >= 1:
            return 0.0
        h = math.atan(abs(r) / math.sqrt(1 - r * r)) / steps
        s = 0.5 * (1 + math.cos(h * steps) ** (n - 3)) + sum(math.cos(h * i) ** (n - 3) for i in range(1, steps))
        return 1 - 2 * s * h * math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt(math.pi)

    rows = [(r, n) for r in (-0.9, -0.3, 0.0, 0.05, 0.5, 0.99, 1.0) for n in (3, 4, 5, 45, 1000)]
    for x in spark.createDataFrame(rows, "r double, n long").withColumn("p", feedback.t_test(F.col("r"), F.col("n"))).collect():
        assert x.p == pytest.approx(plain(x.r, x.n), abs=1e-8)


def test_library_stays_within_its_budget(spark):
    kept = convergence.within_budget(studies.levels(spark), generators.registry(spark)).collect()
    top = {}
    for r in kept:
        top[r.fractal] = max(top.get(r.fractal, 0), r.level)
    assert studies.levels(spark).count() == 36 and top == {"koch": 7, "dragon": 8, "hilbert": 8, "minkowski": 5, "sierpinski": 8}
    for name, level, n in (("koch", 2, 16), ("dragon", 3, 64), ("hilbert", 3, 63), ("minkowski", 2, 64), ("sierpinski", 3, 81)):
        assert studies.make(spark, name, level).count() == n


def test_candidates_and_best_fit(spark):
    p = spark.createDataFrame([("a", 0.5, 1.4, 12.9, 2.0, 1.0)], "curve_id string, initial_delta double, delta_factor double, num_steps double, domain_width double, interface_width double")
    got = consensus.scale_candidates(p).collect()
    assert [(r.name, r.initial_delta, r.num_steps) for r in got] == [("suggested", 0.5, 12), ("domain_scaled", 0.1, 12), ("interface_scaled", 0.2, 12), ("conservative", 0.01, 20)]
    m = spark.createDataFrame([("a", 0, 1.2, 0.9), ("a", 1, 1.3, 0.95), ("a", 2, 1.4, 0.95), ("a", 3, float("nan"), 1.0)], "curve_id string, combo_idx int, dimension double, r_squared double")
    assert consensus.best_fit(m).first().combo_idx == 1


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "curve_id string, seg_idx long, x1 double, y1 double, x2 double, y2 double")
    assert features.features(none).count() == 0
    one = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0)], none.schema)
    row = rules.classify(features.features(one)).first()
    assert row.n_segments == 1 and row.interface_type == "straight_line"
