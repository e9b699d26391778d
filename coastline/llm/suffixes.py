"""Repeated passages by sparse suffix arrays.

Of every text, only the suffixes at minimiser positions are kept: of each run of
``min_words`` words the one whose first ``gram`` words have the smallest hash,
the leftmost if there are several. The choice depends on the run's words alone,
so equal runs keep a suffix at the same place wherever they stand, and every run
belongs to one kept suffix. Suffixes whose first gram only one document has are
dropped; the others are sorted by what follows, and each is compared with its
nearest neighbours of other documents on both sides. The match is extended to the
right and to the left, and where both together reach ``min_words`` the passage is
reported.

The nearest neighbour to the right of a suffix need not be the one that matches
furthest to the left. So an exact check follows: where a suffix has runs that its
neighbours leave open (no longer to the right than its best neighbour matches),
the runs of its group of equal grams are compared by their hashes. Passages of a
document that overlap are joined, so that passages longer than the context
compared come out whole, with one of the documents that share a part of them.

At scale: a suffix travels with at most ``min_words`` words of context on either
side, as 32-bit hashes. Suffixes of a document that are equal with all their
context, as in a text that says one thing over and over, are thinned out. A group
is one task's work up to ``HOT`` suffixes; larger ones are dealt by document,
each share is sorted and compared by itself, and their runs, aggregated in the
tasks, are compared across the shares by a shuffle on the runs' hashes.

Rows: a null text has no words; a row without an id is left out, since no
result could name it; rows that share an id are one document; passages repeated
within one document only are not reported; repeated rows report once; ties
between partners go to the smallest id that was compared; texts of any length are
taken whole; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coastline.llm.common import cut, shuffle_partitions
from coastline.llm.shingles import mix, runs, word_hashes

MIN_WORDS = 50
GRAM = 8
#: Suffixes of one gram that one task takes.
HOT = 2_000
#: Suffixes that are handled at a time.
BATCH = 4_000

NO_KEY = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def minimisers(words: np.ndarray, gram: int = GRAM, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept suffixes: positions, hashes of their first grams, first and last start of the runs that are theirs."""
    hashes = runs(words, gram)
    window = least - gram + 1
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, hashes[:0], none, none
    best = sliding_window_view(hashes, window).argmin(1) + np.arange(len(hashes) - window + 1)
    at, low, count = np.unique(best, return_index=True, return_counts=True)
    return at, hashes[at], low, low + count - 1


def _thinned(at: np.ndarray, contexts: list[bytes], step: int) -> np.ndarray:
    """Which suffixes stay: of those with equal contexts, no two within ``step`` have another in between."""
    keep = np.ones(len(at), bool)
    last: dict[bytes, tuple[int, int]] = {}  # context -> position of the last one kept, index of the last one seen
    for i, (p, c) in enumerate(zip(at.tolist(), contexts, strict=True)):
        had = last.get(c)
        if had is None:
            last[c] = (p, i)
            continue
        kept, seen = had
        if p - kept <= step and at[seen] != kept:
            keep[seen] = False
        last[c] = (kept if p - kept <= step else int(at[seen]), i)
    return keep


def _table(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as rows of ``width`` words, and how many words each has."""
    rows = column.to_pylist()
    n = np.fromiter((len(r) for r in rows), np.int64, len(rows)) // 4
    return np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in rows), np.uint32).reshape(len(rows), width), n


class Block:
    """Sorted suffixes of whole groups, and what is found among them."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, least: int):
        number = lambda name: batch.column(name).to_numpy()
        self.least, self.n = least, batch.num_rows
        self.doc, self.pos, self.low, self.high, self.open = number("doc"), number("pos"), number("low"), number("high"), number("hot")
        self.right, self.nr = _table(batch.column("right"), least)
        self.left, self.nl = _table(batch.column("left"), least)
        h, salt = number("h"), number("salt")
        new = np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))
        self.group, self.h = np.cumsum(new) - 1, h

    def _common(self, rows: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.concatenate([rows[a] == rows[b], np.zeros((len(a), 1), bool)], 1).argmin(1)
        return np.minimum(same, np.minimum(n[a], n[b]))

    def neighbours(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(doc, start, end, partner) found, and which suffixes have runs that are still open."""
        i = np.arange(self.n)
        run = np.append(True, (self.doc[1:] != self.doc[:-1]) | (self.group[1:] != self.group[:-1]))
        first = np.maximum.accumulate(np.where(run, i, 0))
        ends = np.append(np.flatnonzero(run)[1:], self.n)
        after = ends[np.cumsum(run) - 1]
        pairs = []
        for other, ok in ((first - 1, first > 0), (np.minimum(after, self.n - 1), after < self.n)):
            ok = ok & (self.group[other] == self.group)
            pairs.append((i[ok], other[ok]))
        out: list[list[np.ndarray]] = [[], [], [], []]
        best = np.zeros(self.n, np.int64)
        covered = np.zeros(self.n, bool)
        compared = [(a, b, self._common(self.right, self.nr, a, b), self._common(self.left, self.nl, a, b)) for a, b in pairs]
        for a, _, r, _ in compared:
            best[a] = np.maximum(best[a], r)
        upto = np.minimum(self.high, self.pos + best - self.least)  # the last run that another document can have
        for a, b, r, left in compared:
            hit = r + left >= self.least
            a, b, r, left = a[hit], b[hit], r[hit], left[hit]
            for x, y in ((a, b), (b, a)):
                for column, v in zip(out, (self.doc[x], self.pos[x] - left, self.pos[x] + r, self.doc[y]), strict=True):
                    column.append(v)
            covered[a] |= (self.pos[a] - left <= self.low[a]) & (self.pos[a] + r - self.least >= upto[a])
        self.upto = upto
        return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out], (self.low <= upto) & ~covered

    def windows(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, start) of the runs of some suffixes that start from low to high."""
        w = self.least
        text = np.concatenate([self.left[rows][:, ::-1], self.right[rows]], 1).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(2 * w, _BASE, np.uint64)))
            back = np.array([pow(pow(int(_BASE), -1, 1 << 64), k, 1 << 64) for k in range(2 * w + 1)], np.uint64)
            sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(text * power[: 2 * w], 1)], 1)
            hashes = mix((sums[:, w:] - sums[:, : w + 1]) * back[: w + 1])
            # runs of different grams can't be equal
            hashes = mix(hashes ^ mix(self.h[rows].astype(np.int64).view(np.uint64))[:, None])
        offset = np.arange(w + 1)[None, :] - w
        start = self.pos[rows][:, None] + offset
        fits = (-offset <= self.nl[rows][:, None]) & (offset + w <= self.nr[rows][:, None])
        k, j = np.nonzero(fits & (start >= low[:, None]) & (start <= high[:, None]))
        return hashes[k, j].view(np.int64), rows[k], start[k, j]


def _by_run(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: the order, where each key begins, its smallest and its largest document."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return order, at, doc[at], doc[np.append(at[1:], len(key)) - 1]


def compare(block: Block) -> list[np.ndarray]:
    """Rows (doc, start, end, partner, key): passages without a key, and runs of hot groups with theirs.

    A run that several documents of the block have comes once, with the first
    and the last of them and no start; its passages are reported as well.
    """
    found, open_rows = block.neighbours()
    out = [[c] for c in found]
    keys = [np.full(len(found[0]), NO_KEY, np.int64)]
    todo = np.zeros(block.n, bool)
    crowd = np.bincount(block.group) > 2
    needs = np.zeros(len(crowd), bool)
    needs[block.group[open_rows]] = True
    todo = (crowd & needs)[block.group] | block.open
    high = np.where(block.open, block.high, block.upto)
    rows = np.flatnonzero(todo & (block.low <= high))
    if len(rows):
        key, row, start = block.windows(rows, block.low[rows], high[rows])
        if len(key):
            doc = block.doc[row]
            order, at, least, most = _by_run(key, doc)
            size = np.diff(np.append(at, len(key)))
            low, up = np.repeat(least, size), np.repeat(most, size)
            doc, start, key, is_open = doc[order], start[order], key[order], block.open[row[order]]
            twice = low < up
            single = ~twice & is_open
            witness = np.zeros(len(key), bool)
            witness[at] = True
            witness &= twice & is_open
            none = np.full(len(key), -1)
            for pick, columns in (
                (twice, (doc, start, start + block.least, np.where(doc == low, up, low))),
                (single, (doc, start, start + block.least, doc)),
                (witness, (low, none, none, up)),
            ):
                for c, v in zip(out, columns, strict=True):
                    c.append(v[pick])
                keys.append(np.full(int(pick.sum()), NO_KEY, np.int64) if pick is twice else key[pick])
    return [np.concatenate(c) for c in [*out, keys]]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per repeated passage: id, start, end (word positions, end exclusive), partner (a document that shares part of it)."""
    if gram > min_words:
        raise ValueError("a gram is a part of min_words words")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, places, hashes = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, h, _, _ = minimisers(word_hashes(text.as_py()), gram, min_words)
                owners.append(np.full(len(at), doc))
                places.append(at)
                hashes.append(h.view(np.int64))
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, owners, places)], names=["h", "doc", "pos"])

    marked = cut(texts.mapInArrow(mark, "h bigint, doc bigint, pos bigint"))
    # cut off from its aggregation, so that both sides of the join are plain shuffles, of which Spark can split hot ones
    counts = marked.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n"))
    repeated = cut(counts.where("a < b").select("h", F.ceil(F.col("n") / hot).cast("int").alias("shares")))
    kept = marked.join(repeated, "h").groupBy("doc").agg(F.collect_set(F.struct("pos", "h", "shares")).alias("at"))  # the suffixes of one document

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([p[c] for p in parts])) for c in range(6)] + [pa.array([x for p in parts for x in p[c]], pa.binary()) for c in (6, 7)]
            parts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["h", "shares", "doc", "pos", "low", "high", "right", "left"])

        for batch in batches:
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                wanted = batch.column(2)[k].values
                pos, h, shares = (wanted.field(c).to_numpy() for c in range(3))
                words = word_hashes(text.as_py())
                at, hashes, low, high = minimisers(words, gram, min_words)
                if not len(at):
                    continue
                where = np.minimum(np.searchsorted(at, pos), len(at) - 1)
                ours = (at[where] == pos) & (hashes[where].view(np.int64) == h)
                order = np.flatnonzero(ours)[np.argsort(pos[ours], kind="stable")]
                short = words.astype(np.uint32)
                for some in np.array_split(order, max(1, -(-len(order) // BATCH))):
                    p, w = pos[some], where[some]
                    right = [short[x : x + min_words].tobytes() for x in p.tolist()]
                    left = [short[max(0, x - min_words) : x][::-1].tobytes() for x in p.tolist()]
                    stay = np.flatnonzero(_thinned(p, [a + b"|" + b for a, b in zip(left, right, strict=True)], min_words - gram))
                    parts.append((h[some][stay], shares[some][stay], np.full(len(stay), doc), p[stay], low[w][stay], high[w][stay], [right[x] for x in stay], [left[x] for x in stay]))
                    if len(stay) >= BATCH // 2 or len(parts) >= 200:
                        yield flushed()
        if parts:
            yield flushed()

    suffixes = texts.join(kept, "doc").select("doc", "text", "at").mapInArrow(contexts, "h bigint, shares int, doc bigint, pos bigint, low bigint, high bigint, right binary, left binary")
    suffixes = suffixes.withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("shares"))).withColumn("hot", F.col("shares") > 1).drop("shares")
    order = ["h", "salt", "right", "doc", "pos"]
    dealt = suffixes.repartition(shuffle_partitions(docs.sparkSession), "h", "salt").sortWithinPartitions(*order)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            columns = compare(Block(rows, min_words))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "start", "end", "partner", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, salt = batch.column("h").to_numpy(), batch.column("salt").to_numpy()
            ends = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
            begun = held and (held[-1].column("h")[-1].as_py(), held[-1].column("salt")[-1].as_py()) != (int(h[0]), int(salt[0]))
            if begun or len(ends):  # the group that ends last may go on in the next batch
                split = int(ends[-1]) if len(ends) else 0
                whole = pa.Table.from_batches([*held, batch.slice(0, split)])
                yield found(whole.combine_chunks())
                held = [batch.slice(split)]
            else:
                held.append(batch)
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    compared = cut(dealt.mapInArrow(search, "doc bigint, start bigint, end bigint, partner bigint, key bigint"))
    no_key = F.col("key") == F.lit(NO_KEY)
    hot_runs = compared.where(~no_key)
    shared = cut(hot_runs.groupBy("key").agg(F.min("doc").alias("a"), F.max("partner").alias("b")).where("a < b"))
    across = hot_runs.where("start >= 0").select("key", "doc", "start", "end").join(shared, "key").select("doc", "start", "end", F.when(F.col("doc") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("partner"))
    found = compared.where(no_key).select("doc", "start", "end", "partner").unionByName(across)
    found = found.groupBy("doc", "start", "end").agg(F.min("partner").alias("partner"))
    by_start = Window.partitionBy("doc").orderBy("start", "end")
    island = F.when(F.col("start") > F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    found = found.withColumn("_i", island).withColumn("_i", F.sum("_i").over(by_start))
    return found.groupBy("doc", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("partner")).select(F.col("doc").alias("id"), "start", "end", "partner")
