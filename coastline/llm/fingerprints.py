"""Document fingerprints: threshold-scaled sketches.

A text's shingles (five words; a shorter text is one shingle) are hashed to 64
bits, and every hash below a fixed fraction of the range is kept, the same
fraction for all texts. Unlike a sketch of fixed size it grows with its text, so
that the sketch of a union is the union of the sketches and the share of a short
text that a very long one contains can be told from the two sketches. With
``SCALE`` 8 the likeness of two texts of n different shingles has a standard
error of at most 1.5 / sqrt(n). A text with words but no hash below the fraction
keeps its smallest hash instead, which the plain rule doesn't: short texts would
otherwise all have the same, empty fingerprint.

All of it is built-in functions on arrays of hashes.

Rows: a null text is the empty one; a text without words has the empty
fingerprint, which is like itself (1) and unlike any other (0); a null id comes
last in the order of ids; texts of any length are hashed whole; rows that share
an id are ordered by their text's hash; repeated rows each get their row, with
the same values; an empty table gives an empty result. ``with_sketch`` keeps all
columns and replaces one that is named like the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastline.llm.common import WORD, ascii_lower, cut, fresh, shuffle_partitions

SHINGLE = 5
#: One hash in this many is kept.
SCALE = 8


def with_sketch(df: DataFrame, text_col: str, out: str = "sketch", scale: int = SCALE, size: int = SHINGLE) -> DataFrame:
    """``df`` with the sorted array of the kept hashes of a text column."""
    w, n, h, k = fresh(4)
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), F.lit(0))
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    df = df.withColumn(n, F.size(w))
    many = F.transform(F.sequence(F.lit(0), F.col(n) - size), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(size)]))
    one = F.transform(F.sequence(F.lit(1), F.lit(1)), lambda _: F.xxhash64(F.col(w)))
    hashes = F.when(F.col(n) >= size, many).when(F.col(n) > 0, one).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(h, hashes)
    bound = F.lit(-(1 << 63) + (1 << 64) // scale)
    df = df.withColumn(k, F.filter(h, lambda x: x < bound))
    kept = F.when(F.size(k) > 0, F.array_sort(F.array_distinct(k))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, kept).drop(w, n, h, k)


def text_of(sketch: Column) -> Column:
    """The sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge(a: Column, b: Column) -> Column:
    """The sketch of the two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the two sets of shingles: common to all."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def previous(keys: DataFrame) -> DataFrame:
    """(k, last, h, n), unique -> (k, h) with the (pk, ph, pn) before it in the order of (last, k, h).

    Before the first comes the last. The keys are dealt by range; the ends of
    the ranges, one row each, are all that meets in one place.
    """
    order = ["last", "k", "h"]
    dealt = cut(keys.repartitionByRange(shuffle_partitions(keys.sparkSession), *order).withColumn("pid", F.spark_partition_id()))
    row = F.struct("k", "h", "n")
    inside = dealt.withColumn("before", F.lag(row).over(Window.partitionBy("pid").orderBy(*order)))
    ends = dealt.groupBy("pid").agg(F.max(F.struct(*order, "n")).alias("end"))
    by_range = Window.orderBy("pid")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("pid", F.coalesce(F.lag("end").over(by_range), F.last("end").over(whole)).alias("end"))
    out = inside.join(F.broadcast(ends), "pid")  # as many rows as partitions
    before = F.coalesce("before", F.struct(F.col("end.k").alias("k"), F.col("end.h").alias("h"), F.col("end.n").alias("n")))
    return out.select("k", "h", before["k"].alias("pk"), before["h"].alias("ph"), before["n"].alias("pn"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per document: id, n_chars, sketch, and those of the edited and of the next text.

    The next text is that of the document that follows by id (after the last:
    the first); the edited text has its last quarter of characters replaced by
    as many of the next text's first (or all).
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(~1)).bitwiseOR(F.col(id_col).isNull().cast("bigint"))
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0).cast("bigint")).alias("k"), h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    no_id = F.col("h").bitwiseAND(F.lit(1)) == 1
    keys = base.groupBy("k", "h").agg(F.max(F.char_length("text").cast("long")).alias("n"))
    before = previous(keys.withColumn("last", no_id))
    # both uses of ``base`` need the same columns by the same key, so its texts are shuffled once
    follows = base.join(before, ["k", "h"]).select(F.col("pk").alias("k"), F.col("ph").alias("h"), "text", "pn")
    follows = with_sketch(follows, "text", "next_sketch", scale).select("k", "h", F.expr("substring(text, 1, int(floor(pn / 4)))").alias("head"), "next_sketch")
    follows = follows.groupBy("k", "h").agg(F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch"))
    both = base.join(follows, ["k", "h"]).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 4)))"), "head"))
    both = with_sketch(both.select(F.when(~no_id, F.col("k")).alias("id"), "n_chars", "text", "edited", "next_sketch"), "text", "sketch", scale).drop("text")
    return with_sketch(both, "edited", "edited_sketch", scale)
