"""Gradient-boosted trees for two classes: logistic loss, histogram splits, complete trees of fixed depth, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """An ensemble: by tree the features and thresholds of its inner nodes, level by level, and its leaves' values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of class 1 for each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, share: float = 0.5) -> Trees:
    """Trees for rows x and classes y (0 or 1). Without a useful split a node passes all rows to its left.

    Each tree is grown on a random share of the rows, drawn alike in every run, and scores them all.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = [np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)]
    positive = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(positive / (1 - positive)))
    chance = np.random.default_rng(1)
    score, inner = np.full(n, base), (1 << depth) - 1
    features, thresholds, leaves = (np.zeros((trees, size)) for size in (inner, inner, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curvature = y - p, p * (1 - p)
        at, own = np.zeros(n, dtype=np.int64), np.flatnonzero(chance.random(n) < share)
        drawn, own_gradient, own_curvature = [b[own] for b in binned], gradient[own], curvature[own]
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            g, h, place = np.empty((nodes, width, bins)), np.empty((nodes, width, bins)), (at[own] - first) * bins
            for f in range(width):
                keys = place + drawn[f]
                g[:, f] = np.bincount(keys, own_gradient, nodes * bins).reshape(nodes, bins)
                h[:, f] = np.bincount(keys, own_curvature, nodes * bins).reshape(nodes, bins)
            g, h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            for f in range(width):
                gain[:, f, len(edges[f]) :] = -1.0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), bins)
                split = gain[k, f, b] > 1e-6
                features[t, first + k] = f
                thresholds[t, first + k] = edges[f][b] if split else np.inf
            chosen = features[t, at].astype(np.int64)
            at = 2 * at + 1 + (x[np.arange(n), chosen] > thresholds[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, curvature, inner + 1)
        leaves[t] = rate * g / (h + penalty)
        score += leaves[t][leaf]
    return Trees(base, features.astype(np.int64), thresholds, leaves, depth)
