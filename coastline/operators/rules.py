"""Decision tables: curve classes, parameters for box counting, rotation angles, grades.

All are conditional column expressions; they add columns and never shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_ANGLES = tuple(float(a) for a in range(0, 91, 5))
#: Angle sets by class.
COARSE_ANGLES = (0.0, 15.0, 30.0, 45.0, 60.0, 75.0, 90.0)
FEW_ANGLES = (0.0, 30.0, 45.0, 60.0, 90.0)
NO_ANGLES = (0.0,)

#: First match wins, all comparisons strict.
CLASSES = """
case when segment_length_cv < 0.001 and direction_change_rate = 0 and angle_std < 0.001 then 'straight_line'
     when linearity_r_squared > 0.99 and direction_change_rate < 0.1 then 'straight_line'
     when direction_change_rate > 0.85 and tortuosity > 3 and complexity_score > 1.5 then 'extreme_turning_fractal'
     when direction_change_rate > 0.7 and tortuosity > 3 then 'high_turning_fractal'
     when direction_change_rate > 0.5 and tortuosity > 1.2 then 'koch_curve'
     when complexity_score > 0.3 then 'complex_fractal'
     when tortuosity > 1.1 then 'moderate_fractal'
     else 'simple_curve' end
"""


def classify(features: DataFrame) -> DataFrame:
    return features.withColumn("interface_type", F.expr(CLASSES))


def _angles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def rotation_policy(df: DataFrame, rotation: bool | Sequence[float] | None = None) -> DataFrame:
    """rotation_angles and rotation_enabled: none, a given list, all, or by class (None)."""
    kind = F.col("interface_type")
    if rotation is None:
        straight = kind == "straight_line"
        angles = (
            F.when(kind.isin("extreme_turning_fractal", "high_turning_fractal"), _angles(ALL_ANGLES))
            .when(kind.isin("koch_curve", "complex_fractal"), _angles(COARSE_ANGLES))
            .when(straight, _angles(NO_ANGLES))
            .otherwise(_angles(FEW_ANGLES))
        )
        return df.withColumns({"rotation_angles": angles, "rotation_enabled": ~straight})
    if rotation is False:
        return df.withColumns({"rotation_angles": F.array().cast("array<double>"), "rotation_enabled": F.lit(False)})
    return df.withColumns({"rotation_angles": _angles(ALL_ANGLES if rotation is True else rotation), "rotation_enabled": F.lit(True)})


def heuristic_parameters(df: DataFrame) -> DataFrame:
    """initial_delta, delta_factor, num_steps and a confidence word by class."""
    kind, size = F.col("interface_type"), F.col("characteristic_length")
    rows = [
        (kind == "straight_line", F.col("mean_segment_length") * 8, 1.8, 25, "high"),
        (kind == "extreme_turning_fractal", size * 0.03, 1.3, 35, "high"),
        (kind == "high_turning_fractal", size * 0.05, 1.4, 30, "high"),
        (kind == "koch_curve", size * 0.1, 1.8, 30, "high"),
        (kind.isin("complex_fractal", "moderate_fractal"), size * 0.2, 1.8, 20, "medium"),
    ]
    last = (size * 0.3, 1.5, 15, "low")
    out = {}
    for k, name in enumerate(("initial_delta", "delta_factor", "num_steps", "confidence_level")):
        value = lambda x: x if isinstance(x, Column) else F.lit(x)
        column = value(last[k])
        for row in reversed(rows):
            column = F.when(row[0], value(row[k + 1])).otherwise(column)
        out[name] = column
    return df.withColumns(out)


def fallback_parameters(df: DataFrame) -> DataFrame:
    """Parameters by class where nothing has been learned."""
    kind = F.col("interface_type")
    mid = kind.isin("complex_fractal", "moderate_fractal", "koch_curve")
    straight = kind == "straight_line"
    return df.withColumns(
        {
            "initial_delta": F.when(straight, 0.5).when(mid, 1.0).otherwise(0.8),
            "delta_factor": F.when(straight, 1.8).when(mid, 1.2).otherwise(1.5),
            "num_steps": F.when(straight, 15).when(mid, 15).otherwise(12),
        }
    )


def conservative_parameters(df: DataFrame) -> DataFrame:
    mean = F.coalesce("mean_segment_length", F.lit(0.1))
    return df.withColumns({"initial_delta": F.least(mean, F.lit(0.25)), "delta_factor": F.lit(1.2), "num_steps": F.lit(8)})


def tier(value: Column, limits: Sequence[tuple[float, str]], last: str, above: bool = False) -> Column:
    """The name of the first limit that the value is under (or over)."""
    out: Column = F.lit(last)
    for limit, name in reversed(limits):
        out = F.when(value > limit if above else value < limit, name).otherwise(out)
    return out


def error_grade(error: Column) -> Column:
    return tier(error, [(2, "excellent"), (5, "good"), (10, "fair")], "poor")


def wide_error_grade(error: Column) -> Column:
    return tier(error, [(5, "excellent"), (10, "good"), (20, "fair")], "poor")


def fit_grade(r_squared: Column) -> Column:
    return tier(r_squared, [(0.99, "excellent"), (0.95, "good"), (0.90, "fair")], "poor", above=True)


def significance(p: Column) -> Column:
    return tier(p, [(0.001, "***"), (0.01, "**"), (0.05, "*")], "")


def improvement_grade(percent: Column) -> Column:
    return tier(percent, [(15, "major"), (5, "moderate"), (0, "slight")], "none", above=True)
