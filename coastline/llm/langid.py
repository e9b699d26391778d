"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled texts. A text is parsed against each automaton into the longest
phrases that occur in the sample; with c phrases over n letters and a sample of
N letters, c * log2(N) / n estimates the bits a letter costs in that language.
The language with the fewest bits wins. Labels are read for learning only.

Texts are normalised first: lower case, every run of characters that are no
letters becomes one space. Whole texts are parsed. Every letter that some
sample has is told apart; only letters that no sample has are one symbol, which
no automaton has either. The transitions of all automata stand in one table of
hashed (state, symbol) keys, so its size is that of the samples, whatever the
number of letters; those of the most frequent letters also stand in an array of at
most ``DENSE`` entries, for speed. One step moves many places of many texts in
all languages by one letter.

To step through long texts side by side, a text is cut into pieces of ``PIECE``
letters, and all pieces are parsed from the start at first. Then each piece is
parsed again from the state that the piece before it ends in, until it meets
the states it had; this is repeated until no state changes. The phrases counted
are those of one parse of the whole text.

Learning takes for each language ``docs_per_language`` labelled rows, those of
up to ``ROW_CHARS`` characters first and among them those whose ids have the
smallest hashes, and of these the first whole ones until ``sample_chars``
characters are reached. That bounds what comes to the driver.

Rows: null texts and texts without a letter are ``und`` with score 0; without
any labelled row all texts are; null labels are not learned; one language only
gives score 1; ties go to the first language in order; texts of any length are
parsed to their end; repeated rows get the same answer; an empty table gives an
empty result; further columns pass through, but those named like a new column,
which it replaces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOCS_PER_LANGUAGE = 96
SAMPLE_CHARS = 40_000
ROW_CHARS = 20_000
PIECE = 512
#: Turns in which all pieces with a new start are parsed again; from then on the first such piece of each text.
TURNS = 4
#: Letters that are parsed at a time, times languages; texts count as a piece at least.
CHUNK = 8_000_000
UNKNOWN = "und"
DENSE = 1 << 25

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """For each code point: 1 if it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] > length[p] + 1:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    return nxt


class CrossParser:
    """The automata of all languages.

    A step's value is four times the next state, plus the phrases that end
    there: one where the symbol doesn't go on with the phrase so far (the next
    state is then the one of the symbol from the root), and one more for a
    symbol that the sample doesn't have, which is a phrase of its own.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        counts = Counter(c for s in samples.values() for c in s.lower() if c.isalpha())
        known = sorted(counts, key=lambda c: (-counts[c], c))
        self.symbols = {ord(c): i for i, c in enumerate(known, 2)}  # 0: no letter, 1: a letter that no sample has
        self.width = len(known) + 2
        keys, values, starts, self.roots, self.bits = [], [], [], [], []
        first = 0
        for language in self.languages:
            sample = self.encode([samples[language]])[0]
            nxt = suffix_automaton(sample.tolist())
            own = np.fromiter((s * self.width + c for s, to in enumerate(nxt) for c in to), np.int64)
            to = np.fromiter((t for to in nxt for t in to.values()), np.int64, len(own))
            root = np.full(self.width, 4 * first + 2, np.int64)  # no transition: one phrase ends before the symbol, and one is the symbol
            for c, t in nxt[0].items():
                root[c] = 4 * (t + first) + 1
            keys.append(own + first * self.width)
            values.append(4 * (to + first))
            starts.append(root)
            self.roots.append(first)
            self.bits.append(np.log2(max(2, len(sample))))
            first += len(nxt)
        self.owner = np.searchsorted(np.array(self.roots), np.arange(first), side="right") - 1 if first else np.zeros(0, np.int64)
        self.root_steps = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self._hash(np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(values) if values else np.zeros(0, np.int64))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open table of at least two places for each key."""
        kind = np.int32 if self.width * (len(self.owner) + 1) < 1 << 31 else np.int64
        self.owner, self.root_steps, self.symbol_type = self.owner.astype(np.int32), self.root_steps.astype(np.int32), kind
        keys = keys.astype(kind)
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full((1 << bits) + 1024, -1, kind), np.zeros((1 << bits) + 1024, np.int32)
        at = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] += 1
        self._forget()

    def _forget(self) -> None:
        """Leave out what is made again where it is used, so that it needn't be held or sent."""
        self.look, self.table = np.zeros(0, np.int32), None
        self.first = min(self.width, DENSE // max(1, len(self.owner)))

    def _dense(self) -> None:
        """Steps of all states with the first symbols, which are the frequent ones."""
        table = np.empty((len(self.owner), self.first), np.int32)
        for c in range(self.first):
            table[:, c] = self._search(np.arange(len(self.owner), dtype=np.int32), np.full(len(self.owner), c, self.symbol_type))
        self.table = table.ravel()

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).view(np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where each state goes with its symbol."""
        rare = np.flatnonzero(symbols >= self.first) if self.first < self.width else ()
        if len(rare) == len(symbols):
            return self._search(states, symbols)
        if self.table is None:
            self._dense()
        at = states * np.int64(self.first) + symbols
        if not len(rare):
            return self.table[at]
        at[rare] = 0
        out = self.table[at]
        out[rare] = self._search(states[rare], symbols[rare])
        return out

    def _search(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = states * self.symbol_type(self.width) + symbols
        at = self._place(keys)
        found = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero(found != keys)
        while len(left):
            missing = found[left] < 0
            lost = left[missing]
            out[lost] = self._from_root(states[lost], symbols[lost])
            left = left[~missing]
            at[left] += 1
            found[left] = self.keys[at[left]]
            hit = found[left] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
        return out

    def _from_root(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = self.root_steps[self.owner[states] * self.width + symbols]
        # at the root itself no phrase ends before the symbol
        return out - (states == np.array(self.roots, np.int32)[self.owner[states]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts one after another, the end of each, and whether it has a letter."""
        lower = [t.lower() for t in texts]
        ends = np.cumsum([len(t) for t in lower])
        points = _points("".join(lower))
        look = getattr(self, "look", np.zeros(0, np.int32))
        if not len(look):
            look = _letters().copy()
            look[list(self.symbols)] = list(self.symbols.values())
            self.look = look
        symbols = look[points]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        keep[starts[starts < len(keep)]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        seen = np.concatenate([[0], np.cumsum(symbols > 0)])
        return symbols[keep].astype(getattr(self, "symbol_type", np.int64)), kept[ends], seen[ends] > seen[starts]

    def phrases(self, symbols: np.ndarray, ends: np.ndarray, piece: int = PIECE, chunk: int = CHUNK) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        roots, most = np.array(self.roots, np.int32), max(piece, chunk // max(1, len(self.roots)))
        if len(ends) != 1 or len(symbols) <= most:
            count, state = self._parse(symbols, ends, piece, roots)
            return count + (state != roots)  # the last phrase of each text
        count, state = np.zeros((1, len(roots)), np.int64), roots[None, :]
        for at in range(0, len(symbols), most):
            part = symbols[at : at + most]
            more, state = self._parse(part, np.array([len(part)]), piece, state[0])
            count += more
        return count + (state != roots)

    def _parse(self, symbols: np.ndarray, ends: np.ndarray, piece: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end, and states at the end, of each text, from a state to start from."""
        roots, k = np.array(self.roots, np.int32), len(self.roots)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        pieces = -(-(ends - starts) // piece)
        owner = np.repeat(np.arange(len(ends)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[owner] + nth * piece
        size = np.minimum(piece, ends[owner] - at)
        order = np.argsort(-size, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))  # a piece's lane
        lane_at, lane_size = at[order], size[order]
        longest = int(lane_size[0]) if len(order) else 0
        steps = np.zeros((longest, k, len(order)), np.int32)
        state = np.repeat(roots[:, None], len(order), 1)
        state[:, where[nth == 0]] = start[:, None]
        began = state.copy()
        active = np.searchsorted(-lane_size, -np.arange(1, longest + 1), side="right")
        for t in range(longest):
            n = active[t]
            done = self.step(state[:, :n].ravel(), np.tile(symbols[lane_at[:n] + t], k)).reshape(k, n)
            steps[t, :, :n] = done
            state[:, :n] = done >> 2
        self._mend(symbols, steps, began, state, owner, nth, where, lane_at, lane_size)
        count = (steps & 3).sum(0)
        out, last = np.zeros((k, len(ends)), np.int64), np.repeat(start[:, None], len(ends), 1)
        final = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
        last[:, owner[final]] = state[:, where[final]]
        for row, c in zip(out, count, strict=True):
            np.add.at(row, owner[order], c)
        return out.T, last.T

    def _mend(self, symbols, steps, began, state, owner, nth, where, lane_at, lane_size) -> None:
        """Parse pieces again from where the ones before them end, until nothing changes."""
        later = np.flatnonzero(nth > 0)
        mine, before = where[later], where[later - 1]
        turn = 0
        while len(later):
            moved = began[:, mine] != state[:, before]
            if turn >= TURNS:  # earlier pieces of a text first: they are the ones that are right for good
                for row in moved:
                    hit = np.flatnonzero(row)
                    _, first = np.unique(owner[later[hit]], return_index=True)
                    row[:] = False
                    row[hit[first]] = True
            lang, which = np.nonzero(moved)
            if not len(lang):
                break
            lane = mine[which]
            now = state[lang, before[which]]
            began[lang, lane] = now
            t = 0
            while len(lane):
                ended = lane_size[lane] <= t
                if ended.any():
                    state[lang[ended], lane[ended]] = now[ended]
                    lang, lane, now = lang[~ended], lane[~ended], now[~ended]
                    if not len(lane):
                        break
                done = self.step(now, symbols[lane_at[lane] + t])
                old = steps[t, lang, lane]
                steps[t, lang, lane] = done
                go = (done >> 2) != (old >> 2)
                lang, lane, now = lang[go], lane[go], done[go] >> 2
                t += 1
            turn += 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits a letter of each text."""
        names, scores, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t]
        while rows and self.languages:
            n = size = 0
            while n < len(rows) and (not n or (size + max(PIECE, len(texts[rows[n]]))) * len(self.languages) <= CHUNK):
                size += max(PIECE, len(texts[rows[n]]))
                n += 1
            now, rows = rows[:n], rows[n:]
            symbols, ends, has = self.encode([texts[i] for i in now])
            cost = self.phrases(symbols, ends) * np.array(self.bits) / np.diff(np.concatenate([[0], ends]))[:, None]
            best = cost.argmin(1)
            ranked = np.sort(cost, 1)
            score = 1 - ranked[:, 0] / ranked[:, 1] if cost.shape[1] > 1 else np.ones(len(now))
            for i, b, s, c, ok in zip(now, best.tolist(), score.tolist(), ranked[:, 0].tolist(), has.tolist(), strict=True):
                if ok:
                    names[i], scores[i], bits[i] = self.languages[b], s, c
        return names, scores, bits


def learn(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, row_chars: int = ROW_CHARS
) -> CrossParser:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    text = F.col(text_col)
    rows = rows.select(F.col(lang_col).alias("lang"), F.greatest(F.octet_length(text), F.lit(row_chars)).alias("z"), F.xxhash64(F.lit("lang"), id_col).alias("h"), text.alias("t"))
    order = Window.partitionBy("lang").orderBy("z", "h", "t")
    few = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_language)
    before = F.coalesce(F.sum(F.char_length("t").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = few.withColumn("before", before).where(F.col("before") < sample_chars)
    samples: dict[str, list] = {}
    for lang, k, t in picked.select("lang", "k", "t").collect():
        samples.setdefault(lang, []).append((k, t))
    return CrossParser({k: "\n".join(t for _, t in sorted(v)) for k, v in samples.items()})


def identify(docs: DataFrame, parser: CrossParser, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_bits; without its texts unless ``with_text``."""
    if parser.languages:
        parser._forget()
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "lang_bits") and (with_text or f.name != text_col)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.float64()), strict=True))], names=[*(f.name for f in kept), "lang_pred", "lang_score", "lang_bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(each, f"{schema + ', ' if kept else ''}lang_pred string, lang_score double, lang_bits double")
