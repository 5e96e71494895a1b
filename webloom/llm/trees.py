"""Bagged decision trees on a bounded sample, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, LEAF, BINS = 31, 6, 8, 48


@dataclass
class Forest:
    """Each tree: feature (-1 in leaves), threshold, left and right child, share of positives."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            out += value[at]
        return out / max(1, len(self.trees))


def _grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, w: np.ndarray):
    feature, threshold, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column in (feature, threshold, left, right, value):
            column.append(0)
        weights, positive = w[rows], (w * y)[rows]
        total, hits = weights.sum(), positive.sum()
        feature[at], value[at] = -1, hits / max(total, 1e-9)
        if depth == DEPTH or total < 2 * LEAF or hits in (0.0, total):
            return at
        best = (1e-9, -1, 0)
        base = hits * hits / total + (total - hits) ** 2 / total
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            n = np.bincount(binned[rows, f], weights=weights, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            p = np.bincount(binned[rows, f], weights=positive, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            m, q = total - n, hits - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (p * p + (n - p) ** 2) / n + (q * q + (m - q) ** 2) / m - base
            gain[(n < LEAF) | (m < LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] < 0:
            return at
        _, f, k = best
        goes = binned[rows, f] <= k
        feature[at], threshold[at] = f, cuts[f][k]
        left[at] = node(rows[goes], depth + 1)
        right[at] = node(rows[~goes], depth + 1)
        return at

    node(np.flatnonzero(w > 0), 0)
    return np.array(feature), np.array(threshold, dtype=float), np.array(left), np.array(right), np.array(value)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Forest:
    """Trees on bootstrap samples in which both classes weigh alike."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Forest([(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.array([share]))])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    trees = []
    for _ in range(TREES):
        picks = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
        trees.append(_grow(x, binned, cuts, y.astype(float), picks * balance))
    return Forest(trees)
