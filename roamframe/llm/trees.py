"""Gradient boosting of small regression trees on binned features, for two classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """edges: per feature its bin borders; trees: (features, bins, leaf values), each a full tree of one depth."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        margin = np.full(len(x), self.start)
        for feature, border, value in self.trees:
            margin += value[_leaf(bins, feature, border)]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _leaf(bins: np.ndarray, feature: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Leaf of every row: node ``i`` goes on to ``2 i + 1`` or, above its border, ``2 i + 2``."""
    node = np.zeros(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    for _ in range((len(feature) + 1).bit_length() - 1):
        node = 2 * node + 1 + (bins[rows, feature[node]] > border[node])
    return node - len(feature)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16) -> Trees:
    """Fit to labels 0 and 1: each round one tree to the gradient of the log loss, its leaves by Newton steps."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, [], float(np.log(mean / (1 - mean))))
    binned = model.binned(x)
    margin = np.full(len(y), model.start)
    width = bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, border = np.zeros(inner, dtype=np.int64), np.full(inner, width, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for i in range(inner):
            own = np.flatnonzero(node == i)
            best = 1e-6
            for k in range(x.shape[1]):
                g = np.cumsum(np.bincount(binned[own, k], slope[own], width))
                h = np.cumsum(np.bincount(binned[own, k], bend[own], width))
                gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, feature[i], border[i] = gain[at], k, at
            node[own] = 2 * i + 1 + (binned[own, feature[i]] > border[i])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        value = rate * g / (h + 1)
        model.trees.append((feature, border, value))
        margin += value[leaf]
    return model


def least_threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold from which on the held-out rows reach this precision; above 1 where none does."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(probability[order][1:] != probability[order][:-1], True) if len(y) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    return float(probability[order][good[-1]]) if len(good) else 1.1
