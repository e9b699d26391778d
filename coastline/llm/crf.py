"""A linear-chain conditional random field with two labels and named binary features."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence


def _add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


class ChainCRF:
    """p(labels) ~ exp(sum of the features' weights where the label is 1 + the transitions' weights)."""

    def __init__(self):
        self.weight: dict[str, float] = defaultdict(float)
        self.trans = [[0.0, 0.0], [0.0, 0.0]]

    def score(self, features: Sequence[str]) -> float:
        return sum(self.weight.get(f, 0.0) for f in features)

    def fit(self, pages: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], epochs: int = 8, rate: float = 0.3, penalty: float = 1e-4) -> ChainCRF:
        """Maximum likelihood by AdaGrad, page after page."""
        squares: dict = defaultdict(lambda: 1e-2)

        def move(key, value: float, gradient: float) -> float:
            gradient += penalty * value
            squares[key] += gradient * gradient
            return value - rate * gradient / math.sqrt(squares[key])

        for _ in range(epochs):
            for features, labels in pages:
                n = len(labels)
                if not n:
                    continue
                s, t = [self.score(f) for f in features], self.trans
                ahead, back = [(0.0, s[0])], [(0.0, 0.0)] * n
                for i in range(1, n):
                    a0, a1 = ahead[-1]
                    ahead.append((_add(a0 + t[0][0], a1 + t[1][0]), s[i] + _add(a0 + t[0][1], a1 + t[1][1])))
                for i in range(n - 2, -1, -1):
                    b0, b1 = back[i + 1]
                    back[i] = (_add(t[0][0] + b0, t[0][1] + s[i + 1] + b1), _add(t[1][0] + b0, t[1][1] + s[i + 1] + b1))
                total = _add(*ahead[-1])
                grad: dict[str, float] = defaultdict(float)
                pairs = [[0.0, 0.0], [0.0, 0.0]]
                for i in range(n):
                    p = math.exp(ahead[i][1] + back[i][1] - total)
                    for f in features[i]:
                        grad[f] += p - labels[i]
                    if i:
                        for x in (0, 1):
                            for y in (0, 1):
                                pairs[x][y] += math.exp(ahead[i - 1][x] + t[x][y] + (s[i] if y else 0.0) + back[i][y] - total)
                        pairs[labels[i - 1]][labels[i]] -= 1
                for f, g in grad.items():
                    self.weight[f] = move(f, self.weight[f], g)
                self.trans = [[move((x, y), t[x][y], pairs[x][y]) for y in (0, 1)] for x in (0, 1)]
        self.weight = dict(self.weight)
        return self

    def decode(self, scores: Sequence[float]) -> list[int]:
        """The most probable labels (Viterbi) for the blocks' scores."""
        if not scores:
            return []
        t, v, back = self.trans, (0.0, scores[0]), []
        for s in scores[1:]:
            zero, one = (v[0] + t[0][0], v[1] + t[1][0]), (v[0] + t[0][1], v[1] + t[1][1])
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            v = (max(zero), s + max(one))
        out = [int(v[1] > v[0])]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]
