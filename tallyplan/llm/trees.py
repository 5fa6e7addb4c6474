"""Gradient-boosted trees in numpy, flattened into node arrays and scored without loops over rows."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees as flat node arrays; a leaf is its own child."""

    def __init__(self, feature, threshold, left, right, value, roots, depth, bias):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.depth, self.bias = roots, depth, bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3, bins: int = 48, rate: float = 0.2, ridge: float = 2.0) -> Forest:
    """Logistic boosting over histogram bins.

    ``monotone`` maps a feature to +1 (score may only rise with it) or -1. A split on such a feature is taken only
    if its children's values are in order, and both sides inherit the midpoint as a bound, so whole trees keep the order.
    """
    n, m = x.shape
    rate_of = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(rate_of / (1 - rate_of)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
        logit = np.full(n, bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-logit))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            root = node(0.0)
            roots.append(root)
            open_ = [(root, np.arange(n), -np.inf, np.inf, 0)]
            while open_:
                k, rows, low, high, level = open_.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = float(np.clip(rate * gs / (hs + ridge), low, high))
                best = (1e-4, None)
                if level < depth and len(rows) >= 20:
                    for j in range(m):
                        size = len(edges[j]) + 1
                        gb = np.cumsum(np.bincount(codes[rows, j], g[rows], size))[:-1]
                        hb = np.cumsum(np.bincount(codes[rows, j], h[rows], size))[:-1]
                        cb = np.cumsum(np.bincount(codes[rows, j], minlength=size))[:-1]
                        vl, vr = gb / (hb + ridge), (gs - gb) / (hs - hb + ridge)
                        gain = gb * vl + (gs - gb) * vr - gs * gs / (hs + ridge)
                        bad = (cb < 8) | (len(rows) - cb < 8)
                        if monotone.get(j):
                            bad |= monotone[j] * (vr - vl) < 0
                        gain = np.where(bad, -1, gain)
                        if len(gain) and gain.max() > best[0]:
                            s = int(gain.argmax())
                            best = (gain[s], (j, s, rate * vl[s], rate * vr[s]))
                if best[1] is None:
                    logit[rows] += value[k]
                    continue
                j, s, vl, vr = best[1]
                a, b = node(0.0), node(0.0)
                feature[k], threshold[k], left[k], right[k] = j, float(edges[j][s]), a, b
                mid = (np.clip(vl, low, high) + np.clip(vr, low, high)) / 2
                sign = monotone.get(j, 0)
                go = codes[rows, j] <= s
                open_.append((a, rows[go], mid if sign < 0 else low, mid if sign > 0 else high, level + 1))
                open_.append((b, rows[~go], mid if sign > 0 else low, mid if sign < 0 else high, level + 1))
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), roots, depth, bias)
