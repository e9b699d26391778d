"""Small boosted trees for a bounded labelled sample, applied as SQL expressions.

The trees are fitted on the driver, in NumPy, and become one SQL expression
(nested conditions on the features), so that scoring runs inside Spark's own code.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + 1.0))


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int):
    """A leaf's value, or (feature, threshold, tree if at most, tree if above); bins: each feature's values by rank."""
    if depth == 0 or len(g) < 2:
        return _leaf(g, h)
    whole, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-9, None)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        gl, hl = (np.cumsum(np.bincount(bins[:, f], v, len(cut) + 1))[:-1] for v in (g, h))
        gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, float(cut[k])))
    if best[1] is None:
        return _leaf(g, h)
    f, t = best[1]
    low = x[:, f] <= t
    return f, t, _tree(x[low], bins[low], cuts, g[low], h[low], depth - 1), _tree(x[~low], bins[~low], cuts, g[~low], h[~low], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _apply(low, x), _apply(high, x))


class BoostedTrees:
    """Logistic loss, Newton leaves, and a probability calibrated on rows that the trees haven't seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 2, rate: float = 0.4):
        held = np.arange(len(y)) % 3 == 2
        self.rate, self.trees = rate, []
        score, own = np.zeros(int((~held).sum())), x[~held]
        values = [np.unique(own[:, f]) for f in range(x.shape[1])]
        cuts = [(v[1:] + v[:-1]) / 2 for v in values]
        bins = np.stack([np.searchsorted(v, own[:, f]) for f, v in enumerate(values)], 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _tree(own, bins, cuts, p - y[~held], p * (1 - p), depth)
            self.trees.append(tree)
            score += rate * _apply(tree, own)
        self.held, self.scale, self.shift = held, *self._calibrate(self.raw(x[held]), y[held])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(_apply(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    @staticmethod
    def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p)
            g = np.array([((p - y) * s).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
            h = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        return float(a), float(b)

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float, own: np.ndarray) -> float:
        """The smallest probability from which on the held-out rows among ``own`` reach the precision; above 1 if none does."""
        p, y = self.probability(x[self.held & own]), y[self.held & own]
        order = np.argsort(-p)
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        ends = np.flatnonzero(np.append(p[order][1:] < p[order][:-1], True))  # ties count together
        good = [k for k in ends if right[k] >= precision]
        return float(p[order][good[-1]]) - 1e-9 if good else 2.0

    def sql(self, feature: Callable[[int], str]) -> str:
        """The calibrated probability as an SQL expression; feature: the expression of a feature by its number."""

        def of(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{self.rate * tree!r}D"
            f, t, low, high = tree
            return f"CASE WHEN {feature(f)} <= {t!r}D THEN {of(low)} ELSE {of(high)} END"

        return f"1D / (1D + exp(-({' + '.join(of(t) for t in self.trees)}) * {self.scale!r}D - {self.shift!r}D))"
