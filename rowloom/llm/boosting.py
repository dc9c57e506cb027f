"""Gradient boosting over weighted cells of small integer features (numpy, on the driver).

The training table is a contingency table: one row per combination of feature values,
with the number of examples of each label.  Its size is bounded by the product of the
features' ranges, whatever the size of the corpus, so counting is Spark's work and
fitting needs no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Node:
    """A split ``feature <= at``, or a leaf with ``value``."""

    def __init__(self, value: float, feature: int = -1, at: int = 0, yes: Node | None = None, no: Node | None = None):
        self.value, self.feature, self.at, self.yes, self.no = value, feature, at, yes, no

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.yes is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.yes.scores(x), self.no.scores(x))

    def column(self, features: list[Column]) -> Column:
        if self.yes is None:
            return F.lit(float(self.value))
        return F.when(features[self.feature] <= self.at, self.yes.column(features)).otherwise(self.no.column(features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> Node:
    total_g, total_h = g.sum(), h.sum()
    leaf = Node(rate * total_g / (total_h + ridge))
    if depth == 0:
        return leaf
    best, gain = None, 1e-6
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= at
            gl, hl = g[left].sum(), h[left].sum()
            got = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
            if got > gain:
                best, gain = (f, int(at), left), got
    if best is None:
        return leaf
    f, at, left = best
    return Node(0.0, f, at, _grow(x[left], g[left], h[left], depth - 1, rate, ridge), _grow(x[~left], g[~left], h[~left], depth - 1, rate, ridge))


def fit(x: np.ndarray, n: np.ndarray, pos: np.ndarray, *, rounds: int = 30, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> list[Node]:
    """Trees for the log odds of the positive label; ``n`` and ``pos`` count examples per cell."""
    prior = np.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    trees, score = [Node(float(prior))], np.full(len(x), prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, pos - n * p, n * p * (1 - p), depth, rate, ridge)
        trees.append(tree)
        score = score + tree.scores(x)
    return trees


def predict(trees: list[Node], x: np.ndarray) -> np.ndarray:
    return sum(t.scores(x) for t in trees)


def column(trees: list[Node], features: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + t.column(features)
    return total


def calibrated_threshold(score: np.ndarray, n: np.ndarray, pos: np.ndarray, precision: float) -> float:
    """Least score whose isotonic estimate of the positive rate reaches ``precision``."""
    blocks: list[list[float]] = []  # least score, examples, positives
    for s in np.unique(score):
        at = score == s
        blocks.append([float(s), float(n[at].sum()), float(pos[at].sum())])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    for s, m, p in blocks:
        if m and (p + 1) / (m + 2) >= precision:
            return s
    return float("inf")
