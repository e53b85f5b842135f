"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth; each split sends values up to its cut to the left."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)
        self.base = np.log((y.sum() + 1) / (n - y.sum() + 1))
        margin, inner = np.full(n, self.base), 2**self.depth - 1
        self.features, self.values, self.leaves = [], [], []
        cells = np.arange(width) * self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            slope, bend = p - y, p * (1 - p)
            feature, value = np.zeros(inner, np.int64), np.full(inner, np.inf)
            place = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                where = ((place - first)[:, None] * width * self.bins + cells + binned).ravel()
                shape = (count, width, self.bins)
                g = np.bincount(where, np.repeat(slope, width), count * width * self.bins).reshape(shape).cumsum(2)
                h = np.bincount(where, np.repeat(bend, width), count * width * self.bins).reshape(shape).cumsum(2)
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain = gain[:, :, :-1].reshape(count, -1)
                best = gain.argmax(1)
                for k in range(count):
                    f, b = divmod(int(best[k]), self.bins - 1)
                    if gain[k, best[k]] > 1e-6 and b < len(self.cuts[f]):
                        feature[first + k], value[first + k] = f, self.cuts[f][b]
                place = 2 * place + 1 + (x[np.arange(n), feature[place]] > value[place])
            place -= inner
            leaf = -np.bincount(place, slope, inner + 1) / (np.bincount(place, bend, inner + 1) + self.ridge) * self.rate
            margin += leaf[place]
            self.features.append(feature)
            self.values.append(value)
            self.leaves.append(leaf)
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, value, leaf in zip(self.features, self.values, self.leaves, strict=True):
            place = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (x[rows, feature[place]] > value[place])
            out += leaf[place - len(feature)]
        return out
