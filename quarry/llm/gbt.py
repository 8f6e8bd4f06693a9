"""Gradient-boosted trees for two classes, and isotonic calibration, in NumPy: trained on the driver on a bounded
matrix, applied to whole Arrow batches on the executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        x = np.ascontiguousarray(x, np.float64)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (v.size - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 8) -> Forest:
    """Newton boosting on histograms. Ties take the first feature and the lowest cut, so a fit is repeatable."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    n, width = x.shape
    mean = np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4)
    base, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(width)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.empty((0, width), np.int64)
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best, where = np.full(nodes, 1e-9), [(0, np.inf)] * nodes
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                slot = (at - first) * k + code[:, j]
                gs, hs, ns = (np.bincount(slot, w, nodes * k).reshape(nodes, k).cumsum(axis=1) for w in (g, h, np.ones(n)))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < least) | (nt - nl < least)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(nodes), cut]
                for i in np.flatnonzero(top > best + 1e-12):
                    best[i], where[i] = top[i], (j, c[cut[i]])
            for i, (j, c) in enumerate(where):
                f[first + i], t[first + i] = j, c
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        slot = at - inner
        value = rate * np.bincount(slot, g, 2**depth) / (np.bincount(slot, h, 2**depth) + ridge)
        margin += value[slot]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    shape = (len(leaves), inner)
    return Forest(base, np.array(features, np.int64).reshape(shape), np.array(thresholds, np.float64).reshape(shape), np.array(leaves, np.float64).reshape(len(leaves), 2**depth))


@dataclass(frozen=True)
class Isotonic:
    """A rising piecewise-linear map of scores to probabilities."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.asarray(score, np.float64)
        straight = np.interp(score, self.x, self.y)
        return np.clip(0.999 * straight + 0.001 * np.asarray(score), 0, 1)  # flat steps keep the order of scores


def isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool-adjacent-violators over (score, label); blocks stand at their mean score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(np.asarray(score, float)[order], np.asarray(y, float)[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    return Isotonic(np.array([s / n for _, n, s in blocks]), np.array([v / n for v, n, _ in blocks]))
