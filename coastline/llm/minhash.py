"""Near-duplicate detection: one-permutation MinHash, bands, star-shaped candidates.

Each distinct text (by its words) becomes one set of shingles. One permutation
gives the set ``bands * rows`` bins: a bin's value is the smallest hash in its
range; an empty bin takes the value of the first non-empty one along a probe
sequence of its own (optimal densification), so that two sets agree in any bin
with a probability that is their similarity. ``rows`` bins make a band, and
texts that agree in a band share a bucket.

A bucket proposes no pairs among its members but a star, from its smallest
member to all others. A bucket of ``CROWD`` members or more, of which one component
holds an eighth and not all, is a group of near copies that its centre joined in
part: ``CENTRES`` members drawn at random become further centres, each against the
members outside its own component, for ``TURNS`` turns at most. A bucket of n
members thus proposes O(n) pairs in all.
Proposals that agree in ``LEAST_BANDS`` bands are confirmed on the full sets, built
again from the two texts. Two sets at a similarity of 0.75 have fewer than two of
the default 40 bands in common with a probability of 5e-6, which is the chance of
missing a link that no other text makes.

The draws are only a first pass. Members of buckets of three or more that still
span several components are finished exactly (``candidates``): in one fixed order of
all shingles, about the rarest first, two sets that are similar enough have their
first common shingle among the first ``prefix_lengths`` of each; every other pair
across components is ruled out by that. Of what is left, most pairs fall by their
``parities``: a set's shingles switch bits of a mark of two bits a shingle or more, and
two marks differ in no more bits than their sets have shingles that the other lacks.
The rest is confirmed on the full sets. The order comes from a table of ``SLOTS``
counters; it decides how many pairs are left, not which links are found.

At scale: exact copies are collapsed first, so a group of copies that holds a
third of all rows is one node. Bucket minima are aggregated before they are
shuffled; joins on hot buckets and hot centres are plain joins that Spark
splits. Nothing is gathered on the driver.

Rows: a null text, or one without words, has an empty set and is linked with
nothing. A row without an id stands for itself: it links nothing, its component
is null and it is kept. Repeated rows each get their row and the same answer; ids
that several texts share are one node. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.llm.common import checkpointed, cut, cut_told
from coastline.llm.components import components
from coastline.llm.shingles import SHINGLE, mix, shingle_set, word_hashes

BANDS, ROWS = 40, 4
SIMILARITY = 75
CENTRES = 4
#: Turns of further centres; what they leave open is finished exactly.
TURNS = 2
CROWD, SHARE = 16, 8
LEAST_BANDS = 2
#: Counters of shingles by their hash, for an order from about the rarest to the most frequent.
SLOTS = 1 << 18
_PROBES = 1024


@cache
def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a non-empty one; at last all bins in turn."""
    seeds = np.arange(bins * _PROBES, dtype=np.uint64) + np.uint64(1 << 40)
    random = (mix(seeds) % np.uint64(bins)).astype(np.int32).reshape(bins, _PROBES)
    turns = (np.arange(bins)[:, None] + np.arange(1, bins)[None, :]) % bins
    return np.concatenate([random, turns.astype(np.int32)], 1)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One value for each bin of a sorted, non-empty set."""
    width = np.uint64((1 << 64) // bins)
    edges = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) * width)
    owner = np.minimum(shingles // width, np.uint64(bins - 1)).astype(np.int64)
    full = np.zeros(bins, bool)
    full[owner] = True
    out = shingles[np.minimum(edges, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    probes = _probes(bins)
    for width in (16, probes.shape[1]):
        if not len(empty):
            break
        ok = full[probes[empty, :width]]
        found = ok.any(1)
        out[empty[found]] = out[probes[empty[found], ok[found].argmax(1)]]
        empty = empty[~found]
    return out


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = signature(shingles, bands * rows).reshape(bands, rows)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32))
        for k in range(rows):
            keys = mix(keys ^ values[:, k])
    return keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, size: int) -> DataFrame:
    """(id, key, n_shingles, bands): equal keys are equal sequences of words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, found = [], [], []
            for text in batch.column(1):
                words = word_hashes(text.as_py())
                shingles = shingle_set(words, size)
                keys.append(hashlib.md5(words.tobytes(), usedforsecurity=False).digest())
                counts.append(len(shingles))
                found.append(band_keys(shingles, bands, rows) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "key", "n_shingles", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id bigint, key binary, n_shingles bigint, bands array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts: (id, text)."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None  # neighbours in a batch often share a centre
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                ta = ta.as_py()
                if last != (a, ta):
                    last, mine = (a, ta), shingle_set(word_hashes(ta), size)
                other = shingle_set(word_hashes(tb.as_py()), size)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(each, "a bigint, b bigint")


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in ``LEAST_BANDS`` bands or more, so that far fewer texts have to move.

    At a similarity of 0.75 a pair agrees in fewer than two of 40 bands with a
    probability of 5e-6.
    """
    right, left = nodes.select(F.col("node").alias("right"), F.col("bands").alias("rb")), nodes.select(F.col("node").alias("left"), F.col("bands").alias("lb"))
    both = pairs.join(right, F.col("b") == F.col("right")).join(left, F.col("a") == F.col("left"))
    return both.where(F.size(F.array_intersect("lb", "rb")) >= LEAST_BANDS).select("a", "b")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many shingles of the texts' sets fall on each slot; texts: (id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(_slots(shingle_set(word_hashes(text.as_py()), size)), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(each, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles of a set of n, in any fixed order, must hold the first one in common: with a set of n or more, and with any set similar enough."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    """A mark of ``bits`` bits, a power of two and 64 at least, as 64-bit words: bit k tells whether an odd number of shingles falls on it."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def parities(own: DataFrame, size: int) -> DataFrame:
    """(node, n, mark, half): the mark of each set, and the same with half as many bits; own: (node, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, halves = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(word_hashes(text.as_py()), size)
                bits = max(128, 1 << (2 * len(shingles) - 1).bit_length())
                sizes.append(len(shingles))
                marks.append(parity(shingles, bits))
                halves.append(parity(shingles, bits // 2))
            words = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, words), pa.array(halves, words)], names=["node", "n", "mark", "half"])

    return own.select("node", "text").mapInArrow(each, "node bigint, n bigint, mark array<bigint>, half array<bigint>")


def within_reach(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their marks do not rule out.

    Two sets similar enough differ by (100 - percent) / (100 + percent) of their
    joint sizes at most, and their marks by no more bits than that. Where one mark is
    twice as long its half is compared; pairs further apart, which only a low percentage
    lets through, are kept.
    """
    side = lambda k: marks.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "mark", "half")])
    both = pairs.join(side("b"), F.col("b") == F.col("node_b")).join(side("a"), F.col("a") == F.col("node_a"))
    a, b = F.size("mark_a"), F.size("mark_b")
    x, y = F.when(a > b, F.col("half_a")).otherwise(F.col("mark_a")), F.when(b > a, F.col("half_b")).otherwise(F.col("mark_b"))
    apart = F.aggregate(F.zip_with(x, y, lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda s, t: s + t)
    close = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return both.where(close | (F.greatest(a, b) > 2 * F.least(a, b))).select("a", "b")


def candidates(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs (a, b) of nodes in different components that can be similar enough; left: (node, component), texts: (id, text)."""
    own = cut(texts.join(left, F.col("id") == F.col("node")).select("node", "component", "text"))
    counts = own.sparkSession.sparkContext.broadcast(shingle_counts(own, size))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, firsts, sizes = batch.slice(at, 500), [], []
                for text in part.column(2):
                    shingles = shingle_set(word_hashes(text.as_py()), size)
                    order = np.lexsort((shingles, counts.value[_slots(shingles)]))
                    sizes.append(len(shingles))
                    firsts.append(shingles[order[: prefix_lengths(len(shingles), percent)[1]]].view(np.int64))
                times = [len(s) for s in firsts]
                owner = pa.array(np.repeat(np.arange(len(times)), times))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(firsts)), part.column(0).take(owner), part.column(1).take(owner), pa.array(np.repeat(sizes, times)),
                        pa.array(np.concatenate([np.arange(k) for k in times])), pa.array(np.repeat([prefix_lengths(n, percent)[0] for n in sizes], times)),
                    ],
                    names=["shingle", "node", "component", "n", "at", "short"],
                )

    firsts = own.mapInArrow(each, "shingle bigint, node bigint, component bigint, n bigint, at bigint, short bigint")
    firsts = cut(firsts.withColumn("short", F.col("at") < F.col("short")))
    sizes = firsts.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"), F.max("short").alias("short"))
    shared = sizes.groupBy("shingle").agg(F.max(F.struct("c", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("k"), F.max("short").alias("s")).where("k > 1 and s")
    firsts = cut(firsts.join(cut(shared.select("shingle", "largest")), "shingle"))
    others = firsts.select("shingle", F.col("node").alias("other"), F.col("component").alias("theirs"), F.col("n").alias("m"), F.col("at").alias("there"), "largest")
    # the first shingle in common leaves room for no more than the rest of either set
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("there"))
    fits = ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("other")))) & (room * (100 + percent) >= (F.col("n") + F.col("m")) * percent)

    def paired(mine: DataFrame, theirs: DataFrame) -> DataFrame:
        both = mine.drop("largest").join(theirs.drop("largest"), "shingle").where((F.col("component") != F.col("theirs")) & fits)
        return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    # one of the two is outside the shingle's largest component, which so never meets itself
    short = firsts.where("short")
    pairs = paired(short.where("component != largest"), others).unionByName(paired(short.where("component = largest"), others.where("theirs != largest")))
    return within_reach(cut(pairs.distinct()), cut(parities(own, size)), percent)


def _stars(found: DataFrame) -> DataFrame:
    """Components as edges: they link what the links behind them do, and are nearly in their last form already, so that few steps follow."""
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, percent: int = SIMILARITY
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = checkpointed(sketches(docs, id_col, text_col, bands, rows, size))
    nodes = marked.where("id is not null and n_shingles > 0").groupBy("key").agg(F.min("id").alias("node"), F.min("n_shingles").alias("n"), F.min_by("bands", "id").alias("bands"))
    nodes = checkpointed(nodes)
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # cut off from its aggregation, so that both sides of the join are plain shuffles, of which Spark can split hot ones
    ends = cut(banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last"))
    members = checkpointed(banded.join(ends, "bucket"))
    proposed = cut(members.where("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    texts = checkpointed(texts.join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi"))
    tried, rows_of = proposed, F.count(F.lit(1))
    found = components(cut(confirmed(plausible(proposed, nodes), texts, size, percent)))
    for turn in range(TURNS):
        own = members.select("bucket", "node", "n").join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
        parts = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.sum("c").alias("k"), F.max("c").alias("most"))
        mixed = own.join(cut(parts.where(f"k >= {CROWD} and most < k and most * {SHARE} >= k").select("bucket")), "bucket")
        draws = [F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn * CENTRES + c)).alias("h"), "node", "component", "n")) for c in range(CENTRES)]
        picked = mixed.groupBy("bucket").agg(F.array_distinct(F.transform(F.array(*draws), lambda x: F.struct(x["node"].alias("centre"), x["component"].alias("theirs"), x["n"].alias("m")))).alias("c"))
        centres = cut(picked.select(F.col("bucket").alias("k"), F.inline("c")))
        alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent  # no sets of other sizes can be similar enough
        across = mixed.join(centres, (F.col("bucket") == F.col("k")) & (F.col("component") != F.col("theirs")) & alike)
        more = across.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        more, told = cut_told(more.join(tried, ["a", "b"], "left_anti"), n=rows_of)
        if not told["n"]:
            break
        new, told = cut_told(confirmed(plausible(more, nodes), texts, size, percent), n=rows_of)
        if not told["n"]:
            break
        tried = tried.unionByName(more)
        found = components(_stars(found).unionByName(new))
    own = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    unsettled = own.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("k")).where("first < last and k > 2")
    left = cut(own.join(cut(unsettled.select("bucket")), "bucket").select("node", "component").distinct())
    new, told = cut_told(confirmed(cut(candidates(left, texts, size, percent)), texts, size, percent), n=rows_of)
    if told["n"]:
        found = components(_stars(found).unionByName(new))
    named = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    out = marked.select("id", "key", "n_shingles").join(named, "key", "left")
    linked = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", linked.alias("component_id"), F.coalesce(F.col("id") == linked, F.lit(True)).alias("kept"))
