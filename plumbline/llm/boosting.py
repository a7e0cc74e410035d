"""Gradient-boosted trees with logistic loss on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS, DEPTH, ROUNDS, RATE, RIDGE, LEAST = 32, 4, 60, 0.2, 1.0, 5.0


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: a feature and a threshold for each inner node, a value for each leaf."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees fitted to labels 0 and 1."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, features, thresholds, leaves = np.full(n, start), [], [], []
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-margin))
        slope, curve = weight * (y - chance), weight * np.maximum(chance * (1 - chance), 1e-6)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            best = np.zeros(count)
            place = (node - first) * BINS
            for j in range(width):
                g = np.bincount(place + binned[:, j], slope, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                h = np.bincount(place + binned[:, j], curve, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(h < LEAST / 8) | (rest_h < LEAST / 8)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(count), cut] > best + 1e-9)
                best[better] = gain[better, cut[better]]
                feature[first + better], threshold[first + better] = j, edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        g, h = np.bincount(leaf, slope, minlength=2**DEPTH), np.bincount(leaf, curve, minlength=2**DEPTH)
        value = RATE * g / (h + RIDGE)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(start, np.stack(features), np.stack(thresholds), np.stack(leaves))
