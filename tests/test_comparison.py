"""Comparisons: groups without rows, errors of 0, thresholds of the evidence, and the kernel's length."""

import numpy as np
import pytest

from coastline.operators import comparison, sensitivity, spectrum


def test_errors_between_groups(spark):
    rows = [("a", "x", 20.0), ("a", "x", 10.0), ("a", "y", 3.0), ("b", "x", 4.0), ("b", "z", 9.0), ("c", "x", 0.0), ("c", "y", 0.0), ("d", "y", None), (None, "y", 30.0)]
    out = {r.k: r for r in comparison.errors_between(spark.createDataFrame(rows, "k string, m string, error_pct double"), ["k"], "m", "x", "y").collect()}
    assert set(out) == {"a", "b", "c", "d", None}
    assert (out["a"].n, out["a"].left_error, out["a"].error_ratio, out["a"].improvement_pct, out["a"].improvement, out["a"].left_grade, out["a"].right_grade) == (3, 15.0, 5.0, 80.0, "major", "fair", "excellent")
    assert (out["b"].right_error, out["b"].error_ratio, out["b"].improvement, out["b"].right_grade) == (None, None, None, None)
    assert (out["c"].error_ratio, out["c"].improvement_pct, out["c"].improvement) == (None, 0.0, "none")
    assert (out["d"].n, out["d"].left_error, out["d"].right_error) == (0, None, None)
    assert out[None].right_grade == "poor"


def test_evidence_of_grid_alignment(spark):
    changes = [("rough", 0, 25.0), ("rough", 1, 5.0), ("rough", 2, 300.0), ("base", 0, 6.0), ("flat", 0, 0.0), ("edge", 0, 10.0), ("wild", 0, 150.0)]
    pairs = [("rough", "base"), ("rough", "flat"), ("edge", "base"), ("flat", "base"), ("wild", "base"), ("base", "wild"), ("none", "base")]
    out = sensitivity.evidence(spark.createDataFrame(changes, "curve_id string, k int, change_pct double"), spark.createDataFrame(pairs, "curve_id string, base_id string"))
    got = {(r.curve_id, r.base_id): (r.ratio, r.evidence, r.verdict) for r in out.collect()}
    assert got == {
        ("rough", "base"): (2.5, 3.0, "confirmed"), ("rough", "flat"): (float("inf"), 3.0, "confirmed"), ("edge", "base"): (pytest.approx(10 / 6), 1.0, "partially confirmed"), ("flat", "base"): (0.0, 0.0, "not confirmed"),
    }


def test_transform_is_the_circular_convolution(rng=np.random.default_rng(5)):
    z = rng.normal(size=64)
    for s in (0.3, 1.5, 6.0, 40.0):
        w = spectrum.morlet((np.arange(np.ceil(6 * s)) - 3 * s) / s) / np.sqrt(s)
        w = w[max(0, len(w) // 2 - 32) :][:64]
        plain = np.array([sum(z[(p + m) % 64] * np.conj(w[m]) for m in range(len(w))) for p in range(64)])
        got = spectrum.transform(z, np.array([s]))[0]
        assert np.sort(np.abs(got)) == pytest.approx(np.sort(np.abs(plain)))
