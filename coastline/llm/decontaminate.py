"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items, lower-cased and cut into words, are put into one suffix
automaton. Every text is then streamed through it word by word; at each word
the automaton knows the longest run ending there that occurs in some item. A
run of ``window`` words or more is contaminated, all of it; so is an occurrence
of a whole item that is shorter than a window.

The items are dealt by their ids into blocks of about ``block_words`` words. A
block's automaton, about 1 KB a word, is built on the driver and sent to the
executors, and the documents pass through it: never is more than one block in
memory anywhere. One block leaves the corpus where it is. With more, the texts are
read once for each, and what a text meets, by its digest and without the text, is
written to the shared folder; each text's entries are put together and joined to the
documents, which are shuffled once, however many blocks there are.

Rows: a null text has no words and no hits; an item that is null or has no
words occurs nowhere; items that share an id count as one; an item without an
id contaminates and counts (all such items as one) but is left out of the list
of ids; repeated rows are handled row by row; an empty benchmark or an empty
table gives no hits; items are met in no particular order, and equal passages
count once; texts of any length are streamed to their end; further columns pass
through, but those named like a new column, which it replaces.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.llm.common import UPPER, cut, fresh

WINDOW = 10
BLOCK_WORDS = 200_000
#: Spans are cut out of texts; a text of which a larger share is hit goes.
MAX_COVERAGE = 0.5

#: Words of UTF-8 bytes after lower-casing A-Z: digits, a-z and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            at = 0
            for w in words:
                at = self._extend(at, w)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.anchor = [0] * len(self.next)  # the state that holds the last `window` words
        for s in order:
            up = self.link[s]
            self.anchor[s] = self.anchor[up] if self.length[up] >= window else s
        self.items: dict[int, set] = defaultdict(set)
        short: dict[int, list] = defaultdict(list)
        for item, words in items:
            at = 0
            for n, w in enumerate(words, 1):
                at = self.next[at][w]
                if n >= window:
                    self.items[self.anchor[at]].add(item)
            if len(words) < window:
                short[at].append((len(words), item))
        self.short: dict[int, list] = {}  # short items that end in a state, its suffixes' included
        if short:
            for s in order:
                if found := short.get(s, []) + self.short.get(self.link[s], []):
                    self.short[s] = found

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        have = nxt[last].get(w)
        if have is not None and length[have] == length[last] + 1:
            return have
        if have is not None:
            return self._split(last, have, w)
        new = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: bytes) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit runs of word positions (end exclusive, in order, merged), the items met, the longest match."""
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        runs: list[tuple[int, int]] = []
        items: set = set()
        state = matched = longest = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched > longest:
                longest = matched
            start = i + 1
            if matched >= window:
                start = i + 1 - matched
                items |= self.items[self.anchor[state]]
            if state in short:
                for n, item in short[state]:
                    if n <= matched:
                        start = min(start, i + 1 - n)
                        items.add(item)
            if start <= i:
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, i + 1))
        return runs, items, longest


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items (item, text) in blocks of about ``block_words`` words; items that share an id are in one block."""
    size = F.regexp_count(F.translate(text_col, UPPER, UPPER.lower()), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"))
    n = bench.agg(F.sum(size.cast("long"))).first()[0] or 0
    count = max(1, -(-n // block_words))
    rows = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    place = F.pmod(F.when(F.col("item").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item")), F.lit(count))
    return [rows.where(place == k) for k in range(count)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs and what stands between them."""
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*parts, raw[at:]]).decode()


def machine(block: DataFrame, window: int) -> Broadcast:
    """A block's automaton, sent to the executors; the block's items pass the driver."""
    return block.sparkSession.sparkContext.broadcast(Automaton([(r.item, words_of(r.text)) for r in block.toLocalIterator()], window))


def met(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """(key, runs, items, longest) of each text that has words in common with a block; texts: (text), key: the text's MD5 digest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                text = text.as_py()
                runs, items, longest = shared.value.scan(words_of(text))
                if longest:
                    rows.append((hashlib.md5(text.encode(), usedforsecurity=False).digest(), [list(r) for r in runs], list(items), longest))
            keys, runs, items, longest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())], names=["key", "runs", "items", "longest"])

    return texts.mapInArrow(each, "key binary, runs array<array<bigint>>, items array<string>, longest bigint")


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    bench_id: str = "item_id",
    bench_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    max_coverage: float = MAX_COVERAGE,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with the columns of the hits.

    decon_words, decon_hits (words hit), decon_items (ids met, sorted),
    decon_n_items, decon_longest (words of the longest match), decon_spans
    (pairs of word positions, end exclusive), decon_drop (the share of hit
    words is over ``max_coverage``) and, if ``with_text``, decon_text (the text
    without the hit spans). Without ``with_text`` the texts are not returned.
    """
    added = [
        ("decon_words", "bigint", pa.int64()), ("decon_hits", "bigint", pa.int64()), ("decon_items", "array<string>", pa.list_(pa.string())), ("decon_n_items", "bigint", pa.int64()),
        ("decon_longest", "bigint", pa.int64()), ("decon_spans", "array<array<bigint>>", pa.list_(pa.list_(pa.int64()))), ("decon_drop", "boolean", pa.bool_()),
    ]
    if with_text:
        added.append(("decon_text", "string", pa.string()))
    new = {n for n, _, _ in added}
    kept = [f for f in docs.schema.fields if f.name not in new and (with_text or f.name != text_col)]
    key_col, met_col, digest_col = fresh(3)
    todo = blocks(bench, bench_id, bench_text, block_words)
    if len(todo) > 1:
        # equal texts meet the same: one row a text and block, aggregated before it is shuffled
        parts = [cut(met(docs.select(F.col(text_col).alias("text")), machine(block, window)).dropDuplicates(["key"])) for block in todo]
        entries = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.collect_list(F.struct("runs", "items", "longest")).alias(met_col)).withColumnRenamed("key", digest_col)
        docs = docs.withColumn(key_col, F.unhex(F.md5(text_col))).join(cut(entries), F.col(key_col) == F.col(digest_col), "left").drop(key_col, digest_col)
    shared = machine(todo[0], window) if len(todo) == 1 else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in added]
            place = batch.schema.get_field_index
            entries = batch.column(place(met_col)).to_pylist() if shared is None else [None] * batch.num_rows
            for text, found in zip(batch.column(place(text_col)), entries, strict=True):
                text = text.as_py()
                words = words_of(text)
                if shared is None:
                    runs = merged([(a, b) for e in found or [] for a, b in e["runs"]])
                    items, longest = {x for e in found or [] for x in e["items"]}, max((e["longest"] for e in found or []), default=0)
                else:
                    runs, items, longest = shared.value.scan(words)
                hits = sum(b - a for a, b in runs)
                row = [len(words), hits, sorted(x for x in items if x is not None), len(items), longest, [list(r) for r in runs], hits > max_coverage * len(words)]
                if with_text:
                    row.append(without(text, runs) if runs else text)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(place(f.name)) for f in kept), *(pa.array(c, t) for c, (_, _, t) in zip(columns, added, strict=True))], names=[*(f.name for f in kept), *(n for n, _, _ in added)]
            )

    return docs.mapInArrow(each, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t, _ in added)]))
