"""Periodic run detection: stretches of words that repeat with one period, in whole texts.

A run is a stretch of consecutive words with smallest period q and a length of at
least ``max(least_words, repeats * q)`` that no neighbouring word extends. The
words i at which word i equals word i + q then form a stretch of
``(repeats - 1) * q`` or more, so it holds a multiple of that: for each period the
grid has a point at every ``(repeats - 1) * q`` words, a harmonic sum of
O(n log n) points over all periods. From every point that repeats at its period,
how far the two copies agree to the right and to the left is found by binary search
over prefix hashes, for all (period, point) pairs of a block at once. Equal runs of
several points and of multiples of a period are one run, of the smallest period. At
last the words themselves are compared: where two stretches only hash alike, the
texts are searched again with hashes of another base.

The work is done by batches of documents in NumPy. Several short texts share one
array of words and each pair stays inside its own text; a long text is an array of its
own. Pairs come in blocks of ``PAIRS``, so that memory grows with the words of one
text and not with its pairs. Nothing is shuffled.

Rows: a null or empty text has no words and no run; repeated rows are handled row by
row; an empty table gives an empty result; runs that tie are all returned. Further
columns pass through, but those named like a new column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coastline.llm.shingles import mix

LEAST_WORDS, REPEATS = 6, 4
#: Pairs of a period and a point that are searched together; words of short texts that share an array.
PAIRS, WORDS = 1 << 20, 1 << 16


def base(turn: int) -> np.uint64:
    """The odd base of the prefix hashes; another one for each turn."""
    return np.uint64(0x9E3779B97F4A7C15 + 2 * turn)


class Words:
    """Words as numbers, with hashes of all prefixes: a stretch of words hashes alike wherever it stands."""

    def __init__(self, numbers: np.ndarray, turn: int = 0):
        up = np.full(len(numbers) + 1, base(turn), np.uint64)
        up[0] = 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(up)
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(numbers.astype(np.uint64) + np.uint64(1)) * self.power[:-1])])

    def alike(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a hash like those from b, where b is not before a."""
        with np.errstate(over="ignore"):
            return (self.prefix[a + n] - self.prefix[a]) * self.power[b - a] == self.prefix[b + n] - self.prefix[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a on (or before a) equal those of b, ``most`` at most, for all pairs at once."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            ok = self.alike(a - middle, b - middle, middle) if back else self.alike(a, b, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def _grid(starts: np.ndarray, ends: np.ndarray, repeats: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, period, point) of all texts, in blocks; a text's points are counted from its first word."""
    n = ends - starts
    periods = n // repeats * (n >= least)
    owner = np.repeat(np.arange(len(n)), periods)
    if not len(owner):
        return
    period = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(1, (repeats - 1) * period)
    points = (n[owner] - period - 1) // step + 1
    upto = np.cumsum(points)
    at = 0
    while at < len(owner):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        many = points[at:end]
        pair = np.repeat(np.arange(at, end), many)
        point = (np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)) * step[pair]
        yield owner[pair], period[pair], starts[owner[pair]] + point
        at = end


def _true(numbers: np.ndarray, first: int, last: int, start: int, end: int, period: int) -> bool:
    """Whether the words (start, end) of the text (first, last) repeat at the period, and no word beside them does."""
    inside = (numbers[start : end - period] == numbers[start + period : end]).all()
    open_left = start > first and numbers[start - 1] == numbers[start - 1 + period]
    open_right = end < last and numbers[end] == numbers[end - period]
    return bool(inside and not open_left and not open_right)


def runs_of(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS, repeats: int = REPEATS, turn: int = 0) -> np.ndarray:
    """Rows (text, start, length, period) of all texts' runs, by text, start and period; texts are (start, end) of ``numbers``."""
    words = Words(numbers, turn)
    found = [np.zeros((0, 4), np.int64)]
    for text, period, point in _grid(starts, ends, repeats, least):
        hit = numbers[point] == numbers[point + period]
        text, period, point = text[hit], period[hit], point[hit]
        ahead = words.common(point, point + period, ends[text] - point - period, False)
        behind = words.common(point, point + period, point - starts[text], True)
        length = behind + ahead + period
        ok = length >= np.maximum(least, repeats * period)
        found.append(_smallest(np.stack([text[ok], (point - behind)[ok], length[ok], period[ok]], 1)))
    rows = _smallest(np.concatenate(found))
    if not all(_true(numbers, int(starts[k]), int(ends[k]), at, at + n, q) for k, at, n, q in rows.tolist()):
        return runs_of(numbers, starts, ends, least, repeats, turn + 1)
    rows[:, 1] -= starts[rows[:, 0]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row for each (text, start, length), of the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[new]


def stays(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of n words whether it is outside all runs (start, length, period) but for their first periods."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _shared(texts: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group: list[list[bytes]] = []
    n = 0
    for words in texts:
        if group and n + len(words) > WORDS:
            yield group
            group, n = [], 0
        group.append(words)
        n += len(words)
    if group:
        yield group


def _group_runs(group: list[list[bytes]], least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the texts of a group, and where each text's rows begin."""
    known: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in group], np.int64)
    numbers = np.fromiter((known.setdefault(w, len(known)) for words in group for w in words), np.int64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    rows = runs_of(numbers, ends - lengths, ends, least, repeats)
    return rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(len(group) + 1))


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS, repeats: int = REPEATS, with_text: bool = True) -> DataFrame:
    """``docs`` with period_words (words of the text), period_runs (structs of start, length and period, by start and then period) and period_text.

    period_text has the words that stay when every run is collapsed to its first
    period, joined by one space. Words are what stands between ASCII white space.
    Without ``with_text`` the texts themselves are not returned.
    """
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    added = [("period_words", "bigint", pa.int64()), ("period_runs", "array<struct<start:bigint,length:bigint,period:bigint>>", run), ("period_text", "string", pa.string())]
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _, _ in added} and (with_text or f.name != text_col)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index
            texts = ((t.as_py() or "").encode().split() for t in batch.column(place(text_col)))  # bytes split at ASCII white space
            counts, all_runs, left = [], [], []
            for group in _shared(texts):
                rows, at = _group_runs(group, least, repeats)
                for k, words in enumerate(group):
                    own = rows[at[k] : at[k + 1]]
                    counts.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
                    if len(own):
                        words = [w for w, ok in zip(words, stays(len(words), own).tolist(), strict=True) if ok]
                    left.append(b" ".join(words).decode())
            columns = [counts, all_runs, left]
            yield pa.RecordBatch.from_arrays([*(batch.column(place(f.name)) for f in kept), *(pa.array(c, t) for c, (_, _, t) in zip(columns, added, strict=True))], names=[*(f.name for f in kept), *(n for n, _, _ in added)])

    return docs.mapInArrow(each, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t, _ in added)]))
