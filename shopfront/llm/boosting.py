"""Gradient-boosted decision trees for two classes, in numpy: binned features, logistic loss."""

from __future__ import annotations

import numpy as np

DEPTH, TREES, RATE, BINS = 3, 40, 0.2, 32


class Boosted:
    """Trees of one depth as arrays: per inner node a feature and a cut, per leaf a value."""

    def __init__(self):
        self.base, self.trees = 0.0, []
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for features, cuts, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), features[node]] > cuts[node])
            total += values[node - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def _grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, slope: np.ndarray, curve: np.ndarray):
    inner = 2**DEPTH - 1
    features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for level in range(DEPTH):
        for at in range(2**level - 1, 2 ** (level + 1) - 1):
            here = np.flatnonzero(node == at)
            best = 1e-6
            total_s, total_c = slope[here].sum(), curve[here].sum()
            for f in range(x.shape[1]):
                s = np.cumsum(np.bincount(binned[here, f], slope[here], BINS + 1))[: len(edges[f])]
                c = np.cumsum(np.bincount(binned[here, f], curve[here], BINS + 1))[: len(edges[f])]
                if not len(s):
                    continue
                gain = s**2 / (c + 1) + (total_s - s) ** 2 / (total_c - c + 1) - total_s**2 / (total_c + 1)
                gain[(c < 1) | (total_c - c < 1)] = 0
                if gain.max() > best:
                    best, features[at], cuts[at] = gain.max(), f, edges[f][gain.argmax()]
            node[here] = 2 * at + 1 + (x[here, features[at]] > cuts[at])
    leaf = node - inner
    values = -RATE * np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + 1)
    return features, cuts, values


def fit(x: np.ndarray, y: np.ndarray, precision: float, seed: int = 5) -> Boosted:
    """Trees, a logistic scale from a fifth of the rows kept aside, and the lowest probability from
    which at least ``precision`` of those rows are positive. With one class only, nothing passes."""
    model = Boosted()
    if len(y) < 20 or y.min() == y.max():
        return model
    aside = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(set(y[aside])) < 2:
        aside[:] = False
    learn = ~aside
    model.base = float(np.log(y[learn].mean() / (1 - y[learn].mean())))
    edges = [np.unique(np.quantile(x[learn, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[learn, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[learn, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(learn.sum(), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        model.trees.append(_grow(x[learn], edges, binned, p - y[learn], p * (1 - p)))
        features, cuts, values = model.trees[-1]
        node = np.zeros(len(margin), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[learn][np.arange(len(node)), features[node]] > cuts[node])
        margin += values[node - (2**DEPTH - 1)]
    judge = aside if aside.any() else learn
    _calibrate(model, model.margin(x[judge]), y[judge])
    p = model.probability(x[judge])
    order = np.argsort(-p)
    share = np.cumsum(y[judge][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    if len(good):
        model.threshold = max(0.5, float(p[order[good[-1]]]))
    return model


def _calibrate(model: Boosted, margin: np.ndarray, y: np.ndarray) -> None:
    inputs, found = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(inputs @ found, -30, 30)))
        slope = inputs.T @ (p - y) + 0.1 * (found - [1.0, 0.0])
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + 0.1 * np.eye(2)
        found = found - np.clip(np.linalg.solve(curve, slope), -1, 1)
    if found[0] > 0:
        model.scale, model.shift = map(float, found)
