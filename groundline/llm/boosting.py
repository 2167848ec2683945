"""Gradient-boosted trees for binary labels, with calibrated scores, in numpy. Small models only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Depth-limited trees on quantile bins under logistic loss; :meth:`calibrate` fits a logistic curve on held-out rows."""

    n_trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 24
    l2: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned, p = self._binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            prob = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, prob - y, prob * (1 - prob))
            self.trees.append(tree)
            raw += self.rate * self._leaf(tree, binned)
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree: split feature and bin by node, value by leaf. A node that gains nothing sends all rows left."""
        inner = 2**self.depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, 1 << 30), np.zeros(len(g), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j in range(binned.shape[1]) if len(rows) else ():
                hist_g = np.cumsum(np.bincount(binned[rows, j], g[rows], self.bins + 1))
                hist_h = np.cumsum(np.bincount(binned[rows, j], h[rows], self.bins + 1))
                gain = hist_g**2 / (hist_h + self.l2) + (total_g - hist_g) ** 2 / (total_h - hist_h + self.l2) - total_g**2 / (total_h + self.l2)
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, feature[k], cut[k] = gain[at], j, at
            node[rows] = 2 * k + 1 + (binned[rows, feature[k]] > cut[k])
        leaves = node - inner
        value = -np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + self.l2)
        return feature, cut, value

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.start + self.rate * sum((self._leaf(t, binned) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 25) -> Boosted:
        """Platt scaling by Newton steps, with targets smoothed away from 0 and 1."""
        raw, n1, n0 = self.raw(x), y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            m = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(m, np.array([((p - t) * raw).sum(), (p - t).sum()]))
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30))) if len(x) else np.zeros(0)
