"""Gradient-boosted regression trees for a binary label, and isotonic calibration of their scores."""

from __future__ import annotations

import numpy as np


class Booster:
    """Trees of fixed depth over binned features, by second-order boosting of the logistic loss.

    A tree is an array of (feature, bin) splits in heap order, and a value per leaf.
    """

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> None:
        self.n_trees, self.depth, self.rate, self.n_bins, self.ridge = trees, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self.knots = (np.array([0.0]), np.array([0.0]))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        points = np.linspace(0, 1, self.n_bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], points)) for j in range(x.shape[1])]
        bins, n_features, width = self._binned(x), x.shape[1], self.n_bins
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                if len(rows) > 1:
                    sums = np.zeros((2, n_features, width))
                    for j in range(n_features):
                        b = bins[rows, j]
                        sums[0, j], sums[1, j] = np.bincount(b, g[rows], width), np.bincount(b, h[rows], width)
                    left, total = sums.cumsum(axis=2), sums.sum(axis=2, keepdims=True)
                    right = total - left
                    gain = left[0] ** 2 / (left[1] + self.ridge) + right[0] ** 2 / (right[1] + self.ridge) - total[0] ** 2 / (total[1] + self.ridge)
                    j, b = divmod(int(np.argmax(gain)), width)
                    if gain[j, b] > 1e-6:
                        feature[node], cut[node] = j, b
                    at[rows] = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
                else:
                    at[rows] = 2 * node + 1
            leaf = at - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge) * self.rate
            z += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        bins, z = self._binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (bins[np.arange(len(x)), feature[at]] > cut[at])
            z += value[at - (2**self.depth - 1)]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Booster:
        """Isotonic steps from log odds to probabilities, by pooling adjacent violators on rows kept for this."""
        z = self.raw(x)
        order = np.argsort(z, kind="stable")
        blocks: list[list[float]] = []
        for zi, yi in zip(z[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([zi, yi, 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1][1] += last[1]
                blocks[-1][2] += last[2]
        if blocks:
            # one doubtful case is added to each step: a step of few rows is no certainty
            self.knots = (np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks]))
        return self

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of log odds."""
        return self.knots[1][np.clip(np.searchsorted(self.knots[0], z, "right") - 1, 0, None)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(x)) if len(x) else np.zeros(0)
