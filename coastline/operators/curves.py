"""Curves as rows: ordered segments keyed by ``curve_id``.

A segment table has curve_id STRING, seg_idx BIGINT and x1, y1, x2, y2 DOUBLE.
Builders here turn point tables into it with one window per curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastline.operators import spread

SEGMENT_COLUMNS = ("curve_id", "seg_idx", "x1", "y1", "x2", "y2")


def numbered_points(df: DataFrame, key: str, order: Sequence[str], y: str) -> DataFrame:
    """(curve_id, pos, x, y): each key's rows in order, x being their number from 1.

    Curves are dealt at once by their id over a number of partitions that grows with
    the rows; what goes by curve next finds them there.
    """
    names = [f"_{i}" for i in range(len(order))]
    dealt = df.select(F.col(key).cast("string").alias("curve_id"), F.col(y).cast("double").alias("y"), *[F.col(o).alias(i) for i, o in zip(names, order, strict=True)]).repartition(spread.tasks(df), "curve_id")
    w = Window.partitionBy("curve_id").orderBy(*names)
    return dealt.select("curve_id", F.row_number().over(w).cast("bigint").alias("pos"), "y").withColumn("x", F.col("pos").cast("double"))


def segments_from_points(points: DataFrame) -> DataFrame:
    """(curve_id, pos, x, y) -> segments between neighbours by pos."""
    w = Window.partitionBy("curve_id").orderBy("pos")
    out = points.select("curve_id", (F.row_number().over(w) - 1).cast("bigint").alias("seg_idx"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.where("x2 is not null")


def endpoints(segs: DataFrame) -> DataFrame:
    """Both ends of each segment, in order: (curve_id, pos, x, y)."""
    both = F.inline(F.array(F.struct((F.col("seg_idx") * 2).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct((F.col("seg_idx") * 2 + 1).alias("pos"), F.col("x2").alias("x"), F.col("y2").alias("y"))))
    return segs.select("curve_id", both)


def length() -> Column:
    return F.expr("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))")


def angle() -> Column:
    """Direction of a segment, in (-pi, pi]."""
    return F.expr("atan2(y2 - y1, x2 - x1)")


def geometry(segs: DataFrame) -> DataFrame:
    return segs.select(*SEGMENT_COLUMNS, length().alias("length"), angle().alias("angle"))


def turns(segs: DataFrame) -> DataFrame:
    """Segments with length, angle and turn: the wrapped angle to the segment before (null for the first)."""
    w = Window.partitionBy("curve_id").orderBy("seg_idx")
    out = geometry(segs).withColumn("_d", F.abs(F.col("angle") - F.lag("angle").over(w)))
    return out.withColumn("turn", F.least("_d", F.lit(6.283185307179586) - F.col("_d"))).drop("_d")


def bounding_boxes(segs: DataFrame) -> DataFrame:
    """(curve_id, xmin, xmax, ymin, ymax, width, height)."""
    box = segs.groupBy("curve_id").agg(
        F.min(F.least("x1", "x2")).alias("xmin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("y1", "y2")).alias("ymax")
    )
    return box.withColumns({"width": F.col("xmax") - F.col("xmin"), "height": F.col("ymax") - F.col("ymin")})


def padded(box: DataFrame, flat: float = 0.01, pad: float = 0.1) -> DataFrame:
    """Domains whose height is under ``flat`` get ``pad`` on both sides."""
    thin = F.col("height") < flat
    out = box.withColumns({"ymin": F.when(thin, F.col("ymin") - pad).otherwise(F.col("ymin")), "ymax": F.when(thin, F.col("ymax") + pad).otherwise(F.col("ymax"))})
    return out.withColumn("height", F.col("ymax") - F.col("ymin"))


def roomy(box: DataFrame, share: float = 0.1, least: float = 0.5) -> DataFrame:
    """Domains padded by a share of their size, or by ``least`` where that is more."""
    px, py = F.greatest(F.col("width") * share, F.lit(least)), F.greatest(F.col("height") * share, F.lit(least))
    out = box.withColumns({"xmin": F.col("xmin") - px, "xmax": F.col("xmax") + px, "ymin": F.col("ymin") - py, "ymax": F.col("ymax") + py})
    return out.withColumns({"width": F.col("xmax") - F.col("xmin"), "height": F.col("ymax") - F.col("ymin")})


def expanded(box: DataFrame, factor: float = 1.4142135623730951, kept: Sequence[str] = ()) -> DataFrame:
    """Domains grown about their centre, so that a rotated curve stays inside; columns that are ``kept``, the centre's cx and cy among them, stay."""
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    hw, hh = F.col("width") * factor / 2, F.col("height") * factor / 2
    out = box.select("curve_id", *[k for k in kept if k not in ("cx", "cy")], cx.alias("cx"), cy.alias("cy"), hw.alias("hw"), hh.alias("hh"))
    out = out.select("curve_id", *kept, (F.col("cx") - F.col("hw")).alias("xmin"), (F.col("cx") + F.col("hw")).alias("xmax"), (F.col("cy") - F.col("hh")).alias("ymin"), (F.col("cy") + F.col("hh")).alias("ymax"))
    return out.withColumns({"width": F.col("xmax") - F.col("xmin"), "height": F.col("ymax") - F.col("ymin")})


def rotated(segs: DataFrame, degrees: Column | str | float, centre: DataFrame | None = None) -> DataFrame:
    """Segments turned by ``degrees``, about the origin or about (cx, cy) of each curve in ``centre``.

    Columns besides those of segments (such as the angle's own) stay.
    """
    a = F.col(degrees) if isinstance(degrees, str) else degrees if isinstance(degrees, Column) else F.lit(float(degrees))
    more = [c for c in segs.columns if c not in SEGMENT_COLUMNS]
    if centre is None:
        segs = segs.withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0)})
    else:
        segs = segs.join(centre.select("curve_id", "cx", "cy"), "curve_id")
    segs = segs.withColumns({"_c": F.cos(F.radians(a)), "_s": F.sin(F.radians(a))})
    put = {}
    for k in ("1", "2"):
        dx, dy = F.col(f"x{k}") - F.col("cx"), F.col(f"y{k}") - F.col("cy")
        put[f"x{k}"] = dx * F.col("_c") - dy * F.col("_s") + F.col("cx")
        put[f"y{k}"] = dx * F.col("_s") + dy * F.col("_c") + F.col("cy")
    return segs.select("curve_id", "seg_idx", *more, *[v.alias(k) for k, v in put.items()])


def centres(box: DataFrame) -> DataFrame:
    return box.select("curve_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))
