"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times the mix should take it. The
rates are those closest to "each document once" in relative entropy that give
each source its target number of words and take no document more than
``max_repeats`` times. By duality they are ``min(cap, exp(lambda * x))`` with
one multiplier per source and ``x`` the document's size over the source's
size-weighted mean size; the multipliers solve a convex problem by a Newton
iteration that is kept within a bracket.

Documents of one source and one size have the same rate, so everything up to
the rounding runs on the table of (source, size, number of documents): its
size grows with the number of different sizes, not with the corpus, and it is
aggregated before it is shuffled. D different sizes take D * D / 2 words at least,
so a source of 5e9 words (30 GB) has 100,000 of them at the very most, and they are
one row: the Newton steps are folds over it, in one job for all sources, taken until each
source is within ``TOLERANCE`` of its target. A job a step would grow the driver.

Rounding: sizes are walked from the largest down, each cell taking the whole
number of copies that brings the running total nearest to its running target,
so that the small documents at the end settle the rest. Within a cell
the extra copies go to the documents with the smallest hash of their id and text.
The largest such hash is looked for in slices of about ``bucket_rows`` documents:
slices are counted, and only the one that the last extra copy falls into is
ranked, so that no group lands in one task. A document then knows its copies
from its own hash and its cell's limit. The texts are not shuffled, unless there
are more than ``BROADCAST_CELLS`` cells; then the join with the cells is a
shuffle join, of which Spark splits hot keys.

Rows: a null text has size 0, is never taken twice and adds nothing; a null
source is a source of its own and the last one; repeated rows count one by
one, and rows equal in id and text share their hash, so which of them get an
extra copy is told by their place in the table; null ids differ by their texts;
texts of any length are counted whole; an empty table gives an empty result;
columns named in ``keep`` pass through, but those named like a column of the result,
which it replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastline.llm.common import WORD, cut, cut_told

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
TOLERANCE = 1e-7
#: A bracket of 128 that is halved at the worst is at the limit of doubles by then.
MOST_STEPS = 64
BUCKET_ROWS = 10_000
RUN = 256
#: Cells of at most about 100 bytes that are sent to all executors.
BROADCAST_CELLS = 200_000
RESULT = ("id", "source", "size", "source_size", "target", "rate", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with weight and target.

    The targets fill up like water: ``min(max_repeats * size, level * weight)``
    with the one level at which they sum to ``share`` of all sizes. There is
    one row per source, so the two windows over all of them stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("_i", F.row_number().over(by_name) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    out = out.withColumn("weight", pick).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_i")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    out = out.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.col("_level") * F.col("weight") <= F.col("_cap")
    out = out.withColumn("_level", F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(all_rows))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return out.select("source", "source_size", "weight", target.alias("target"))


def sizes_of(cells: DataFrame) -> DataFrame:
    """(source, size, n) -> a row per source: source_size, mean, and cells, an array of (size, n) from the largest size down."""
    n, z = F.col("n"), F.col("size")
    mean = F.sum(n * z.cast("decimal(19,0)") * z).cast("double") / F.nullif(F.sum(n * z), F.lit(0))
    return cells.groupBy("source").agg(F.sum(n * z).alias("source_size"), mean.alias("mean"), F.reverse(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("cells"))


def _power(lam: Column, x: Column) -> Column:
    return F.exp(F.least(lam * x, F.lit(50.0)))


def tilt(sources: DataFrame, max_repeats: float = MAX_REPEATS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source_size, mean, cells, target, ...) -> with full and lam, the multiplier.

    Newton on log(words taken) against the log of the target, which is nearly
    linear in the multiplier; a step that leaves the bracket known so far is
    replaced by its middle. A target at the cap needs no multiplier.
    """
    cap, aim = F.lit(float(max_repeats)), F.col("target")
    full = aim >= F.col("source_size") * cap
    x = lambda c: F.when(F.col("mean") > 0, c["size"] / F.col("mean")).otherwise(F.lit(0.0))
    weighed = F.transform("cells", lambda c: F.struct((c["n"] * c["size"]).cast("double").alias("w"), x(c).alias("x")))
    out = sources.withColumns({"full": full, "_weighed": weighed})

    def more(sums: Column, c: Column, lam: Column) -> Column:
        power = _power(lam, c["x"])
        return F.struct((sums["took"] + c["w"] * F.least(cap, power)).alias("took"), (sums["slope"] + F.when(power < cap, c["w"] * c["x"] * power).otherwise(F.lit(0.0))).alias("slope"))

    def moved(at: Column, took: Column, slope: Column) -> Column:
        above = took > aim
        lo, hi = F.when(above, at["lo"]).otherwise(at["lam"]), F.when(above, at["lam"]).otherwise(at["hi"])
        newton = F.when((slope > 0) & (took > 0) & (aim > 0), at["lam"] - F.log(took / aim) * took / slope)
        to = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        there = (F.abs(took - aim) <= tolerance * aim) | (hi - lo < 1e-15)
        return F.struct(F.when(there, at["lam"]).otherwise(to).alias("lam"), lo.alias("lo"), hi.alias("hi"), there.alias("there"))

    def step(at: Column, _: Column) -> Column:
        sums = F.aggregate("_weighed", F.struct(F.lit(0.0).alias("took"), F.lit(0.0).alias("slope")), lambda s, c: more(s, c, at["lam"]))
        # an array of one, so that the sums are taken once a step
        return F.when(at["there"], at).otherwise(F.element_at(F.transform(F.array(sums), lambda s: moved(at, s["took"], s["slope"])), 1))

    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-64.0).alias("lo"), F.lit(64.0).alias("hi"), (F.col("full") | F.col("mean").isNull()).alias("there"))
    lam = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, step, lambda at: at["lam"])
    return out.withColumn("lam", lam).drop("_weighed")


def round_cells(sources: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Rates -> whole copies per cell, largest sizes first, carrying the error in words.

    The fold runs over runs of ``RUN`` different sizes of one source. Each run
    ends within half of its smallest size of its own target.
    """
    run = F.transform(F.sequence(F.lit(0), F.size("cells") - 1, F.lit(RUN)), lambda k: F.slice("cells", k + 1, RUN))
    lists = sources.select("source", "source_size", "target", "mean", "full", "lam", F.explode(run).alias("_cells"))
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<size:bigint,n:bigint,rate:double,copies:bigint>>").alias("done"))
    cap = F.lit(float(max_repeats))

    def rated(c: Column) -> Column:
        power = _power(F.col("lam"), F.when(F.col("mean") > 0, c["size"] / F.col("mean")).otherwise(F.lit(0.0)))
        rate = F.when(c["size"] == 0, F.lit(1.0)).when(F.col("full"), cap).otherwise(F.least(cap, power))
        return F.struct(c["size"].alias("size"), c["n"].alias("n"), rate.alias("rate"))

    def step(acc: Column, c: Column) -> Column:
        words = c["n"] * c["rate"] * c["size"] + acc["owed"]
        most = (c["n"] * F.lit(int(max_repeats))).cast("long")
        copies = F.when(c["size"] == 0, c["n"]).otherwise(F.least(most, F.greatest(F.lit(0).cast("long"), F.round(words / c["size"]).cast("long"))))
        owed = F.when(c["size"] == 0, acc["owed"]).otherwise(words - copies * c["size"])
        return F.struct(owed.alias("owed"), F.concat(acc["done"], F.array(F.struct(c["size"].alias("size"), c["n"].alias("n"), c["rate"].alias("rate"), copies.alias("copies")))).alias("done"))

    done = F.aggregate(F.transform("_cells", rated), start, step, lambda acc: acc["done"])
    return lists.select("source", "source_size", "target", F.inline(done))


def limits(keys: DataFrame, cells: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """cells (source, size, n, copies, ...) -> with base, last and share.

    A row of the cell gets ``base`` copies, one more if its hash is below
    ``last``, and one more with the probability ``share`` if it is ``last``.
    keys: (source, size, h) of each row.
    """
    parts = F.ceil(F.col("n") / F.lit(int(bucket_rows)))
    base = F.floor(F.col("copies") / F.col("n"))
    cells = cells.withColumns({"parts": parts, "base": base, "extra": F.col("copies") - base * F.col("n")})
    some = cells.where("extra > 0").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "parts", "extra")
    # slices of the hashes' range, in its order: a bit shift keeps the product within a bigint
    high = F.shiftright("h", 31) + F.lit(1 << 32)
    ours = keys.join(some, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select("_s", "_z", "h", "extra", F.floor(high * F.col("parts") / F.lit(1 << 33)).alias("slice"))
    slices = ours.groupBy("_s", "_z", "slice", "extra").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("_s", "_z").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = cut(slices.withColumn("before", before).where("before < extra and before + c >= extra").select(F.col("_s").alias("_a"), F.col("_z").alias("_b"), F.col("slice").alias("_at"), "before"))
    near = ours.join(at, F.col("_s").eqNullSafe(F.col("_a")) & (F.col("_z") == F.col("_b")) & (F.col("slice") == F.col("_at")))
    near = near.groupBy("_s", "_z", "h", "extra", "before").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("_s", "_z").orderBy("h")) + F.col("before")
    last = near.withColumn("upto", upto).where("upto >= extra and upto - m < extra").select(F.col("_s").alias("_a"), F.col("_z").alias("_b"), F.col("h").alias("last"), ((F.col("extra") - F.col("upto") + F.col("m")) / F.col("m")).alias("share"))
    return cells.join(last, F.col("source").eqNullSafe(F.col("_a")) & (F.col("size") == F.col("_b")), "left").drop("_a", "_b", "parts", "extra")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    bucket_rows: int = BUCKET_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies; and the columns of ``docs`` named in ``keep``."""
    kept = [c for c in keep if c not in RESULT]
    hashed = F.xxhash64(F.lit("mix"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    row = F.struct(F.lit(0).alias("id"), *[F.col(f"`{c}`") for c in kept])
    sized = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hashed.alias("h"))
    keys = cut(sized.select("id", "source", "size", "h"))
    cells = keys.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = cut(sizes_of(cells))
    t = source_targets(sources.select("source", "source_size"), weights, share, max_repeats).select(F.col("source").alias("_s"), "target")
    sources = sources.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    copies = cut(round_cells(tilt(sources, max_repeats), max_repeats))
    done, told = cut_told(limits(keys, copies, bucket_rows).withColumnsRenamed({"source": "_s", "size": "_z"}), n=F.count(F.lit(1)))
    if told["n"] <= BROADCAST_CELLS:
        done = F.broadcast(done)
    out = (sized if kept else keys.withColumn("row", F.struct(F.lit(0).alias("id")))).join(done, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    # rows of one hash are told apart by their place; there is one, as a rule, and its share is 1
    luck = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / F.lit(1 << 20)
    more = F.when(F.col("h") < F.col("last"), 1).when((F.col("h") == F.col("last")) & (luck < F.col("share")), 1).otherwise(0)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "id", "source", "size", "source_size", "target", "rate", (F.col("base") + more).cast("long").alias("copies"))
