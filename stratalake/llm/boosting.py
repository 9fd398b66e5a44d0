"""Gradient-boosted regression trees with logistic loss, small enough to train on the driver and ship to tasks."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees as nested tuples (feature, cut, low, high) or leaf values; scores are log-odds."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, l2: float = 1.0):
        self.count, self.depth, self.rate, self.l2, self.trees = trees, depth, rate, l2, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
        f = np.zeros(len(y))
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, x, g, h, at, cuts, depth):
        gain = lambda a, b: a * a / (b + self.l2)
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-6, None, None)
        if depth and len(at) > 8:
            for j, places in enumerate(cuts):
                slot = np.searchsorted(places, x[at, j], side="left")  # slot <= k: value <= places[k]
                low_g = np.cumsum(np.bincount(slot, g[at], len(places) + 1))[:-1]
                low_h = np.cumsum(np.bincount(slot, h[at], len(places) + 1))[:-1]
                gains = gain(low_g, low_h) + gain(total_g - low_g, total_h - low_h) - gain(total_g, total_h)
                if len(gains) and gains.max() > best[0]:
                    best = (gains.max(), j, places[gains.argmax()])
        if best[1] is None:
            return float(self.rate * total_g / (total_h + self.l2))
        low = x[at, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, at[low], cuts, depth - 1), self._grow(x, g, h, at[~low], cuts, depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._apply(low, x), self._apply(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))))


def calibrated_cut(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut on held-out scores at and above which `precision` of the examples are positive; over 1 if none is."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    ok = np.nonzero((right >= precision) & last)[0]
    return float(p[order][ok[-1]]) if len(ok) else 2.0
