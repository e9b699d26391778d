"""Hashes of words and of word runs, in NumPy, for whole batches of a text's bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Bytes that are hashed at a time; cut between words.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd multipliers for the words of a run.
_PLACES = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def _spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _piece_hashes(raw: np.ndarray, space: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(max(PIECE * 2, 1 << int(len(raw) + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of the text; A-Z count as a-z, words are separated by ASCII white space."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    space = _spaces(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not space[end]:
            end += 1
        parts.append(_piece_hashes(raw[at:end], space[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out += words[k : k + n] * _PLACES[k]
    return mix(out)


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, without words there is none."""
    return np.unique(runs(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)
