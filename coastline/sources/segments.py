"""Segment text files: a lenient scan, a strict one, and the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: a number as segment files write it.
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def parse(texts: DataFrame, strict: bool = False) -> DataFrame:
    """(curve_id, text) -> segments in the order of lines.

    Blank lines and those that begin with # are skipped. Leniently, a line's
    first four numbers count, whatever stands between them, and lines with fewer
    are dropped; strictly, each line is four numbers or the query fails.
    """
    lines = texts.select("curve_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"^[ \t\r\f]+|[ \t\r\f]+$", ""))).where("line != '' and not startswith(line, '#')")
    if strict:
        parts = F.split("line", r"\s+")
        bad = F.concat(F.lit("not four numbers: "), F.col("line"))
        lines = lines.withColumn("v", F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(bad).cast("array<string>")))
    else:
        lines = lines.withColumn("v", F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0))).where("size(v) >= 4")
    w = Window.partitionBy("curve_id").orderBy("line_no")
    return lines.select("curve_id", (F.row_number().over(w) - 1).cast("bigint").alias("seg_idx"), *[F.element_at("v", k + 1).cast("double").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def read(spark: SparkSession, path: str, strict: bool = False, name: str = r"([^/]+)$") -> DataFrame:
    """All segment files under a path; a curve is named by its file, or by the group that ``name`` finds in the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("curve_id"), F.col("value").alias("text"))
    return parse(files, strict)


def _number(c: Column, exact: bool) -> Column:
    return c.cast("string") if exact else F.format_string("%.6f", c)


def lines(segs: DataFrame, title: str | None = None, dimension: float | None = None, exact: bool = False) -> DataFrame:
    """(curve_id, line_no, line): the text of segment files, with a header of four lines if there is a title."""
    body = segs.select("curve_id", (F.col("seg_idx") + 4).alias("line_no"), F.concat_ws(" ", *[_number(F.col(c), exact) for c in ("x1", "y1", "x2", "y2")]).alias("line"))
    if title is None:
        return body
    head = segs.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(F.lit(f"# {title}"), F.concat(F.lit("# Segments: "), F.col("n").cast("string")), F.lit(f"# Theoretical dimension: {dimension}"), F.lit("#"))
    return head.select("curve_id", F.posexplode(rows).alias("line_no", "line")).select("curve_id", F.col("line_no").cast("bigint").alias("line_no"), "line").unionByName(body)


def write(segs: DataFrame, path: str, title: str | None = None, dimension: float | None = None, exact: bool = False) -> None:
    """One folder of text for each curve, lines in order."""
    out = lines(segs, title, dimension, exact)
    out.repartition("curve_id").sortWithinPartitions("curve_id", "line_no").select("curve_id", "line").write.partitionBy("curve_id").text(path)
