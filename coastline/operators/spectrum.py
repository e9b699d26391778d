"""Spectra and wavelets of curves: height functions, power spectral density, wavelet energies, and what follows.

FFTs are grouped NumPy kernels over one curve's resampled heights (a fixed
number of points); the aggregates and decision tables are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coastline.operators.curves import endpoints

POINTS = 512
SCALES = 32
#: How much of a level or limit is put down to rounding.
SHARE = 1e-9


def height_function(segs: DataFrame, points: int = 1024) -> DataFrame:
    """(curve_id, x0, step, heights): each curve's unique points by (x, y), resampled on an even grid.

    Every gap between neighbours in x fills the grid places that lie in it, so
    that only the ``points`` heights of a curve are gathered.
    """
    curve = Window.partitionBy("curve_id")
    order = curve.orderBy("x", "y")
    p = endpoints(segs).select("curve_id", "x", "y").distinct()
    p = p.withColumns({"x0": F.min("x").over(curve), "step": (F.max("x").over(curve) - F.min("x").over(curve)) / max(1, points - 1)})
    p = p.withColumn("lo", F.expr(f"cast(case when step > 0 then least({points - 1}, ceil((x - x0) / step - 1e-9D)) else 0 end as int)"))
    p = p.withColumns({"x2": F.lead("x").over(order), "y2": F.lead("y").over(order), "hi": F.lead("lo").over(order) - 1})
    p = p.withColumns({"hi": F.when(F.col("x2").isNull(), points - 1).otherwise(F.col("hi"))}).where("hi >= lo")
    grid = p.withColumn("i", F.explode(F.sequence("lo", "hi")))
    h = F.expr("case when x2 is null or x2 = x then y else y + (y2 - y) * (x0 + i * step - x) / (x2 - x) end")
    lists = grid.groupBy("curve_id", "x0", "step").agg(F.array_sort(F.collect_list(F.struct("i", h.alias("h")))).alias("h"))
    return lists.select("curve_id", "x0", "step", F.col("h.h").alias("heights"))


def density(h: np.ndarray, step: float, method: str = "welch") -> tuple[np.ndarray, np.ndarray]:
    """One-sided power spectral density without the zero frequency.

    welch: Hann windows of min(256, n // 4) points, half overlapping, each
    with its mean removed; periodogram: one rectangular window; multitaper: the
    mean over sine tapers.
    """
    h, fs = h - h.mean(), 1 / step
    n = len(h)
    if method == "multitaper":
        k = np.arange(1, 8)[:, None]
        tapers = np.sqrt(2 / (n + 1)) * np.sin(np.pi * k * np.arange(1, n + 1)[None, :] / (n + 1))
        power = (np.abs(np.fft.rfft(tapers * h, axis=1)) ** 2).mean(0) / fs
        size = n
    else:
        size = min(256, n // 4) if method == "welch" else n
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if method == "welch" else np.ones(n)
        starts = range(0, n - size + 1, max(1, size // 2))
        parts = [h[a : a + size] for a in starts]
        power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], 0) / (fs * (window**2).sum())
    power[1 : len(power) - (size % 2 == 0)] *= 2
    return np.fft.rfftfreq(size, step)[1:], power[1:]


def _first(cumulative: np.ndarray, level: float) -> int:
    """The first place at or over the level, but for ``SHARE`` of it that rounding may lack; 0 if there is none."""
    return int((cumulative >= level * (1 - SHARE)).argmax())


def _area(y: np.ndarray, x: np.ndarray) -> float:
    """Integral by trapezoids."""
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def _or_whole(x: np.ndarray, cumulative: np.ndarray, low: float, high: float) -> float:
    """From where the cumulative share reaches ``low`` to where it reaches ``high``, or all if that is no range."""
    a, b = _first(cumulative, low), _first(cumulative, high)
    return float(x[b] - x[a] if b > a else x[-1] - x[0])


def spectral_row(h: np.ndarray, step: float, method: str) -> dict[str, float]:
    f, p = density(h, step, method)
    whole, peak = _area(p, f), float(f[p.argmax()])
    ok = (f > 0) & (p > 0)
    slope = np.nan
    if ok.sum() >= 3:
        low, high = np.percentile(f[ok], [20, 80])
        band = ok & (f >= low) & (f <= high)
        if band.sum() >= 3:
            slope = -float(np.polyfit(np.log10(f[band]), np.log10(p[band]), 1)[0])
    top, right = f > np.percentile(f, 75), f > np.median(f)
    mean = _area(f * p, f) / whole if whole > 0 else 0.0
    share, last = np.cumsum(p), _first(np.cumsum(p), 0.95 * p.sum())
    over = _area(p[right], f[right])
    return {
        "dominant_frequency": peak, "spectral_slope": slope, "high_freq_content": _area(p[top], f[top]) / whole if whole > 0 else 0.0,
        "spectral_bandwidth": _or_whole(f, share * (f[1] - f[0]) / whole, 0.025, 0.975) if whole > 0 and len(f) > 1 else np.nan, "spectral_centroid": mean,
        "spectral_rolloff": float(f[last] if last > 0 else f[-1]), "low_high_ratio": _area(p[~right], f[~right]) / over if over > 0 else np.inf, "peak_ratio": peak / mean if mean > 0 else 1.0,
    }


SPECTRAL = ("dominant_frequency", "spectral_slope", "high_freq_content", "spectral_bandwidth", "spectral_centroid", "spectral_rolloff", "low_high_ratio", "peak_ratio")


def spectral_features(heights: DataFrame, method: str = "welch") -> DataFrame:
    """Eight features per curve; a curve too short or flat in x gets nulls and the reason."""

    def each(frames):
        for frame in frames:
            rows = []
            for c, step, h in zip(frame["curve_id"], frame["step"], frame["heights"], strict=True):
                row = dict.fromkeys(SPECTRAL, None) | {"curve_id": c, "error": None}
                try:
                    if step <= 0 or len(h) < 16:
                        raise ValueError("too short")
                    row |= spectral_row(np.asarray(h, float), step, method)
                except (ValueError, FloatingPointError) as e:  # one bad curve doesn't end the others
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["curve_id", *SPECTRAL, "error"])

    return heights.mapInPandas(each, "curve_id string, " + ", ".join(f"{n} double" for n in SPECTRAL) + ", error string")


def morlet(t: np.ndarray, f0: float = 6.0) -> np.ndarray:
    return np.exp(2j * np.pi * f0 * t - t**2 / 2) / np.sqrt(np.pi**0.25)


def transform(signal: np.ndarray, scales: np.ndarray, wavelet: Callable[[np.ndarray], np.ndarray] = morlet) -> np.ndarray:
    """Continuous transform (scales x places): circular correlation with the wavelet at each scale, cut or padded to the signal's length."""
    n = len(signal)
    out, spectrum = np.zeros((len(scales), n), complex), np.fft.fft(signal)
    for row, s in zip(out, scales, strict=True):
        # three scales to either side; a whole number of steps is not one more by rounding
        t = np.arange(np.ceil(6 * s * (1 - SHARE))) - 3 * s if s > 0 else np.zeros(0)
        if not len(t):
            continue
        w = wavelet(t / s) / np.sqrt(s)
        spare = n - len(w)
        w = np.pad(w, (spare // 2, spare - spare // 2)) if spare >= 0 else w[len(w) // 2 - n // 2 :][:n]
        row[:] = np.fft.ifft(spectrum * np.fft.fft(np.conj(w[::-1])))
    return out


def peaks(v: np.ndarray, height: float) -> list[int]:
    """Places higher than both sides, the middle one of a level stretch, of at least a height."""
    out, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i] and v[i] >= height:
            out.append((i + j) // 2)
        i = j + 1
    return out


WAVELET = ("wavelet_entropy", "intermittency", "multiscale_complexity", "energy_concentration", "scale_bandwidth", "large_small_ratio")


def wavelet_row(h: np.ndarray, step: float, scales: int | Sequence[float] = SCALES, wavelet: Callable[[np.ndarray], np.ndarray] = morlet) -> dict:
    domain = step * (len(h) - 1)
    z = h - h.mean()
    if z.std() > 0:
        z = z / z.std()
    grid = np.logspace(np.log10(domain / 256), np.log10(domain / 4), scales) if isinstance(scales, int) else np.asarray(scales, float)
    size = np.abs(transform(z, grid, wavelet))
    energy = (size**2).mean(1)
    out = {"domain_scale": float(domain), "energy_distribution": energy.tolist(), "dominant_scales": []}
    if energy.sum() == 0:
        return out
    p, n = energy / energy.sum(), len(grid)
    found = peaks(p, 0.05) or [int(p.argmax())]
    fine, some = p[2 * n // 3 :].sum(), p[p > 0]
    ordered = np.cumsum(np.sort(p))
    return out | {
        "energy_distribution": p.tolist(), "dominant_scales": grid[found].tolist(), "wavelet_entropy": float(-(some * np.log2(some)).sum()) if len(some) > 1 else 0.0,
        "intermittency": float((size.max(1) / (size.mean(1) + 1e-10)).mean()), "multiscale_complexity": float(p.var()), "energy_concentration": float((n + 1 - 2 * ordered.sum() / ordered[-1]) / n) if n > 1 else 1.0,
        "scale_bandwidth": abs(_or_whole(grid, np.cumsum(p), 0.1, 0.9)), "large_small_ratio": float(p[: n // 3].sum() / fine) if fine > 0 else float("inf"),
    }


def wavelet_features(heights: DataFrame, scales: int | Sequence[float] = SCALES, wavelet: Callable[[np.ndarray], np.ndarray] = morlet) -> DataFrame:
    """Energy distribution over the scales (by number: log-spaced from 1/256 to 1/4 of the domain), dominant scales and six scalars."""
    names = ["curve_id", "energy_distribution", "dominant_scales", *WAVELET, "domain_scale", "error"]

    def each(frames):
        for frame in frames:
            rows = []
            for c, step, h in zip(frame["curve_id"], frame["step"], frame["heights"], strict=True):
                out = dict.fromkeys(names, None) | {"curve_id": c}
                if step > 0 and len(h) >= 8:
                    out |= wavelet_row(np.asarray(h, float), step, scales, wavelet)
                else:
                    out["error"] = "too short"
                rows.append(out)
            yield pd.DataFrame(rows, columns=names)

    doubles = ", ".join(f"{n} double" for n in WAVELET)
    return heights.mapInPandas(each, f"curve_id string, energy_distribution array<double>, dominant_scales array<double>, {doubles}, domain_scale double, error string")


def _or(name: str, default: str) -> str:
    return f"case when {name} is null or isnan({name}) or abs({name}) = double('Infinity') then {default} else {name} end"


def spectral_parameters(df: DataFrame) -> DataFrame:
    """Features and domain_scale -> parameters and confidence."""
    df = df.withColumns({"_f": F.expr("case when dominant_frequency > 0 and dominant_frequency < double('Infinity') then dominant_frequency when domain_scale > 0 then 1 / domain_scale else 1D end"), "_s": F.expr(_or("spectral_slope", "1.5D")), "_hf": F.expr(_or("high_freq_content", "0.2D"))})
    df = df.withColumn("_bw", F.expr("case when spectral_bandwidth > 0 and spectral_bandwidth < double('Infinity') then spectral_bandwidth else _f end"))
    missing = " + ".join(f"cast({n} is null or isnan({n}) or abs({n}) = double('Infinity') as int)" for n in SPECTRAL)
    return df.withColumns(
        {
            "initial_delta": F.expr("greatest(0.001D * domain_scale, least(0.2D * domain_scale, domain_scale / (10 * _f)))"),
            "delta_factor": F.expr("case when _s > 2.5 then 1.8D when _s > 1.5 then 1.5D when _s > 0.5 then 1.3D else 1.2D end * case when _hf > 0.3 then 0.9D else 1D end"),
            "num_steps": F.expr(f"cast(greatest(8D, least(25D, floor(12 * (case when _bw > 2 * _f * (1 + {SHARE}D) then 1.5D when _bw < 0.5D * _f * (1 - {SHARE}D) then 0.7D else 1D end * case when _s > 2 then 1.3D when _s < 1 then 0.8D else 1D end)))) as int)"),
            "confidence": F.expr(
                f"greatest(0D, least(1D, (1 - 0.1D * ({missing})) * case when spectral_slope is null or isnan(spectral_slope) then 0.5D when spectral_slope between 0.5D and 3D then 1D else 0.7D end"
                " * case when peak_ratio is null or isnan(peak_ratio) or peak_ratio = double('Infinity') then 1D when peak_ratio > 1.5D then 1D when peak_ratio > 1.2D then 0.9D else 0.7D end))"
            ),
        }
    ).drop("_f", "_s", "_hf", "_bw")


def wavelet_parameters(df: DataFrame) -> DataFrame:
    """Wavelet features -> parameters, confidence and the class of scaling."""
    d = {"_r": _or("large_small_ratio", "1D"), "_e": _or("wavelet_entropy", "1D"), "_c": _or("energy_concentration", "0.5D"), "_m": _or("multiscale_complexity", "0.1D"), "_b": _or("scale_bandwidth", "domain_scale")}
    df = df.withColumns({k: F.expr(v) for k, v in d.items()}).withColumn("_p", F.expr("coalesce(try_element_at(dominant_scales, 1), 0.1D * domain_scale)"))
    missing = " + ".join(f"cast({n} is null or isnan({n}) or abs({n}) = double('Infinity') as int)" for n in WAVELET)
    df = df.withColumns(
        {
            "initial_delta": F.expr("greatest(0.001D * domain_scale, least(0.3D * domain_scale, 2 * _p))"),
            "delta_factor": F.expr("case when _r > 3 then 1.8D when _r > 1.5 then 1.6D when _r > 0.7 then 1.4D when _r > 0.3 then 1.3D else 1.2D end * case when _c > 0.8 then 0.9D when _c < 0.3 then 1.1D else 1D end"),
            "num_steps": F.expr(
                "cast(greatest(8D, least(30D, floor(12 * (case when _e > 3 then 1.4D when _e > 2 then 1.2D when _e > 1 then 1D else 0.8D end * case when _m > 0.2 then 1.3D when _m > 0.1 then 1.1D else 0.9D end"
                " * case when _b / domain_scale > 0.5 then 1.2D when _b / domain_scale > 0.2 then 1D else 0.8D end)))) as int)"
            ),
            "confidence": F.expr(
                f"greatest(0D, least(1D, case when size(dominant_scales) = 0 then 0.6D when size(dominant_scales) > 3 then 0.8D else 1D end * case when size(energy_distribution) = 0 then 0.5D when array_max(energy_distribution) > 0.9 then 0.7D"
                f" when array_max(energy_distribution) < 0.1 then 0.8D else 1D end * (1 - 0.1D * ({missing})) * case when wavelet_entropy < 0.5 or wavelet_entropy > 5 then 0.8D else 1D end))"
            ),
        }
    )
    return df.drop(*d, "_p")


def wavelet_scaling(df: DataFrame) -> DataFrame:
    """Power law of the energies over scales from 0.01 to 1 (log-spaced): exponent, fit and class."""
    e = df.select("curve_id", F.size("energy_distribution").alias("n"), F.posexplode_outer("energy_distribution").alias("i", "e"))
    e = e.withColumn("x", F.expr("-2 + 2 * i / (n - 1)"))
    fit = e.groupBy("curve_id").agg(F.max("n").alias("n"), F.count_if(F.expr("e > 0")).alias("k"), F.expr("regr_slope(log10(e), x) filter (where e > 0)").alias("exponent"), F.expr("regr_r2(log10(e), x) filter (where e > 0)").alias("r_squared"))
    kind = F.when(F.coalesce("n", F.lit(0)) <= 0, "unknown").when(F.col("k") < 3, "insufficient_data").when(F.col("r_squared") <= 0.8, "non_fractal")
    kind = kind.when((F.col("exponent") > -2) & (F.col("exponent") < 0), "strong_fractal").when((F.col("exponent") > -3) & (F.col("exponent") < -2), "moderate_fractal").otherwise("weak_fractal")
    return fit.select("curve_id", "exponent", "r_squared", kind.alias("scaling_class"))
