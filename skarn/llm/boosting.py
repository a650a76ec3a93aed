"""Gradient boosting of small trees for two classes, with Platt calibration. Fitted on the driver, a few kilobytes."""

from __future__ import annotations

import numpy as np

DEPTH = 3


class Boosted:
    """Complete trees of DEPTH levels on quantile bins, logistic loss, Newton leaves."""

    def __init__(self, trees: int = 120, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.n_trees, self.rate, self.bins, self.smooth = trees, rate, bins, smooth
        self.features, self.cuts, self.leaves = [], [], []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        score = np.zeros(len(y))
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node, feature, cut = np.zeros(len(y), dtype=np.int64), [], []
            for level in range(DEPTH):
                for k in range(1 << level):
                    own = node == k
                    f, c = self._split(binned[own], grad[own], hess[own])
                    feature.append(f)
                    cut.append(edges[f][c] if c < len(edges[f]) else np.inf)
                base = (1 << level) - 1
                node = 2 * node + (x[np.arange(len(y)), np.array(feature)[base + node]] > np.array(cut)[base + node])
            n = 1 << DEPTH
            leaf = self.rate * np.bincount(node, grad, n) / (np.bincount(node, hess, n) + self.smooth)
            score += leaf[node]
            self.features.append(feature)
            self.cuts.append(cut)
            self.leaves.append(leaf)
        self.features, self.cuts, self.leaves = np.array(self.features), np.array(self.cuts), np.array(self.leaves)
        return self

    def _split(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best = (0.0, 0, self.bins)
        total_g, total_h = grad.sum(), hess.sum()
        whole = total_g**2 / (total_h + self.smooth)
        for f in range(binned.shape[1]):
            g = np.cumsum(np.bincount(binned[:, f], grad, self.bins))
            h = np.cumsum(np.bincount(binned[:, f], hess, self.bins))
            gain = g**2 / (h + self.smooth) + (total_g - g) ** 2 / (total_h - h + self.smooth) - whole
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), f, k)
        return best[1], best[2]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling by Newton steps on held-out rows."""
        m = self.margin(x)
        design = np.stack([m, np.ones(len(m))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-design @ w))
            weight = p * (1 - p) + 1e-6
            w = w + np.linalg.solve(design.T @ (design * weight[:, None]) + 0.1 * np.eye(2), design.T @ (y - p) - 0.1 * (w - [1, 0]))
        self.slope, self.shift = w
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))
