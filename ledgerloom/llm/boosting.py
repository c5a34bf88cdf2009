"""Gradient-boosted trees over binned features, logistic loss; small and dependency-free."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete binary trees of one depth: features and thresholds by node, values by leaf."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, bin_: np.ndarray, value: np.ndarray, start: float) -> None:
        self.edges, self.feature, self.bin, self.value, self.start = edges, feature, bin_, value, start

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of features."""
        b = self.binned(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.bin, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, f[node]] > t[node])
            out += v[node - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Trees for labels of 0 and 1."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    shell = Trees(edges, None, None, None, 0.0)
    b = shell.binned(x)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    f = np.full(n, start)
    features, bins, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, BINS, dtype=np.int64)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            for k in range(m):
                slot = (node - first) * (BINS + 1) + b[:, k]
                gs = np.bincount(slot, weights=g, minlength=many * (BINS + 1)).reshape(many, -1)
                hs = np.bincount(slot, weights=h, minlength=many * (BINS + 1)).reshape(many, -1)
                gl, hl = np.cumsum(gs, axis=1), np.cumsum(hs, axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                at = np.argmax(gain, axis=1)
                top = gain[np.arange(many), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[first + i], threshold[first + i] = top[i], k, at[i]
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        v = rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + ridge)
        f += v[leaf]
        features.append(feature)
        bins.append(threshold)
        values.append(v)
    return Trees(edges, np.array(features), np.array(bins), np.array(values), start)
