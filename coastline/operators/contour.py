"""Contour lines of a field: each cell's four triangles cut by a level.

A cell's corners meet by two windows along the grid's rows and columns; a cell
is four triangles about its centre, whose value is the corners' mean, and a
triangle that the level passes gives one segment. A cell of which a corner is
missing gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(field: DataFrame) -> DataFrame:
    """(time, ix, iy) with the coordinates and values of the cell's corners a, b, c, d, around it."""
    along_y = Window.partitionBy("time", "ix").orderBy("iy")
    above = F.lead("iy").over(along_y)
    up = field.select("time", "ix", "iy", "x", "y", "f", F.lead("y").over(along_y).alias("y2"), F.when(above == F.col("iy") + 1, F.lead("f").over(along_y)).alias("f_up"), above.alias("iy2"))
    along_x = Window.partitionBy("time", "iy").orderBy("ix")
    both = up.select("*", F.lead("x").over(along_x).alias("x2"), F.lead("f").over(along_x).alias("f_right"), F.lead("f_up").over(along_x).alias("f_both"), F.lead("ix").over(along_x).alias("ix2"))
    return both.where("iy2 = iy + 1 and ix2 = ix + 1 and f is not null and f_up is not null and f_right is not null and f_both is not null")


def contours(field: DataFrame, level: float = 0.5) -> DataFrame:
    """Segments of the level's contour of each time: curve_id is the time, seg_idx counts by cell and triangle."""
    c = cells(field).withColumns({"xc": F.expr("(x + x2) / 2"), "yc": F.expr("(y + y2) / 2"), "fc": F.expr("(f + f_right + f_up + f_both) / 4")})
    corner = {"a": ("x", "y", "f"), "b": ("x2", "y", "f_right"), "c": ("x2", "y2", "f_both"), "d": ("x", "y2", "f_up"), "m": ("xc", "yc", "fc")}

    def cross(p: str, q: str) -> Column:
        """Where the edge p-q meets the level, from the lower name on, so that neighbours agree; null if it doesn't."""
        (x1, y1, f1), (x2, y2, f2) = (tuple(map(F.col, corner[k])) for k in sorted((p, q)))
        t = (F.lit(level) - f1) / (f2 - f1)
        hit = (f1 < level) != (f2 < level)
        return F.when(hit, F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y")))

    def triangle(k: int, p: str, q: str) -> Column:
        ends = F.filter(F.array(cross(p, q), cross(q, "m"), cross(p, "m")), lambda e: e.isNotNull())
        return F.when(F.size(ends) == 2, F.struct(F.lit(k).alias("k"), F.get(ends, 0).alias("a"), F.get(ends, 1).alias("b")))

    found = F.filter(F.array(*[triangle(k, *pair) for k, pair in enumerate((("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")))]), lambda s: s.isNotNull())
    rows = c.select("time", "ix", "iy", F.explode(found).alias("s"))
    w = Window.partitionBy("time").orderBy("ix", "iy", "s.k")
    return rows.select(F.col("time").cast("string").alias("curve_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seg_idx"), F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def binned(points: DataFrame) -> DataFrame:
    """(time, ix, iy, value) of any number of rows -> the field of the bins' means; bins without a row are missing nodes."""
    means = points.where("value is not null").groupBy("time", "ix", "iy").agg(F.avg("value").alias("f"))
    return means.select("time", "ix", "iy", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "f")


def by_frame(field: DataFrame, level: float = 0.5) -> DataFrame:
    """(time, n_segments, length) of the contour of each frame; a frame without a contour keeps its row, with 0 segments."""
    found = contours(field, level).groupBy(F.col("curve_id").cast("double").alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))")).alias("l"))
    out = field.select(F.col("time").cast("double").alias("time")).distinct().join(found, "time", "left")
    return out.select("time", F.coalesce("n", F.lit(0)).cast("long").alias("n_segments"), F.coalesce("l", F.lit(0.0)).alias("length"))
