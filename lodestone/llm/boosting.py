"""Gradient-boosted shallow trees for a yes-or-no target, on NumPy alone: small tables, trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: feature and cut of inner nodes (a row goes right where x > cut), values of leaves."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)])
    size = max(len(c) for c in cuts) + 1
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, start)
    inner = 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            of = (node - first) * size
            rows = np.bincount(node - first, minlength=wide)
            gs, hs = (np.array([v[node == first + q].sum() for q in range(wide)]) for v in (g, h))
            best, whole = np.full(wide, 1e-9), gs**2 / (hs + penalty)
            for j in range(width):
                k = len(cuts[j])
                if not k:
                    continue
                # Sums by node and bin, all nodes of a level at once.
                key = of + binned[j]
                gl = np.cumsum(np.bincount(key, g, wide * size).reshape(wide, size), 1)[:, :k]
                hl = np.cumsum(np.bincount(key, h, wide * size).reshape(wide, size), 1)[:, :k]
                gain = gl**2 / (hl + penalty) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + penalty) - whole[:, None]
                most = gain.max(1)
                for q in np.flatnonzero((most > best) & (rows > 1)):
                    best[q], f[first + q], c[first + q] = most[q], j, cuts[j][gain[q].argmax()]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        margin += v[leaf]
        features.append(f)
        thresholds.append(c)
        values.append(v)
    return Trees(start, np.array(features), np.array(thresholds), np.array(values))
