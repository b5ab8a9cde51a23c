"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into quantile bins once; each level of a tree is grown from
histograms of gradients and hessians over (node, feature, bin).  Trees are
complete and of one depth, so the fitted model is three arrays (feature,
threshold, leaf value) and scoring moves all rows through all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # (trees, 2**depth - 1); a row goes right if its value is greater
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for the rows of x."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        trees = np.arange(len(self.feature))[:, None]
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            rows = np.arange(len(part))[None, :]
            node = np.zeros((len(self.feature), len(part)), dtype=np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[lo : lo + 4096] += self.leaf[trees, node - inner].sum(axis=0)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """x: (rows, features), y: 0 or 1.  With one class only (or no rows), a model that always says that class (or even odds)."""
    n, k = x.shape
    ones = float(y.sum())
    base = float(np.log((ones + 1e-3) / (n - ones + 1e-3)))
    inner = (1 << depth) - 1
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if ones in (0, n):
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(k) * bins
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes = 1 << level
            at = ((node * k)[:, None] * bins + flat).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, k), minlength=nodes * k * bins).reshape(nodes, k, bins) for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            cut_at = np.full(nodes, bins)
            for m in range(nodes):
                if gain[m].flat[best[m]] > 1e-9:
                    j, b = divmod(int(best[m]), bins)
                    feature[nodes - 1 + m], threshold[nodes - 1 + m], cut_at[m] = j, edges[j][b], b
            node = 2 * node + (binned[np.arange(n), feature[nodes - 1 + node]] > cut_at[node])
        leaf = -rate * np.bincount(node, g, minlength=inner + 1) / (np.bincount(node, h, minlength=inner + 1) + l2)
        margin += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
