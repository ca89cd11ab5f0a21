"""A small gradient-boosted tree learner, and its trees as SQL expressions.

Fits on the driver on a bounded sample (numpy); scores anywhere as a Column, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: "Leaf | Split"
    high: "Leaf | Split"


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple
    #: Slope and intercept that turn raw scores into probabilities, fitted on held-out rows.
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.intercept)))

    def score(self, features: list[Column]) -> Column:
        """probability() as an expression."""
        raw = F.lit(self.bias)
        for tree in self.trees:
            raw = raw + _expression(tree, features)
        return 1 / (1 + F.exp(-(raw * self.slope + self.intercept)))


def _values(node: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(node, Leaf):
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.at, _values(node.low, x), _values(node.high, x))


def _expression(node: Leaf | Split, features: list[Column]) -> Column:
    if isinstance(node, Leaf):
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.at, _expression(node.low, features)).otherwise(_expression(node.high, features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Leaf | Split:
    """Newton leaf, or the split with the greatest gain; ties go to the first feature and cut."""
    total_g, total_h = g.sum(), h.sum()
    best = (1e-6, None)
    if depth and len(x) >= 8:
        for f in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 24), method="nearest"))
            for at in cuts:
                low = x[:, f] <= at
                if low.all() or not low.any():
                    continue
                lg, lh = g[low].sum(), h[low].sum()
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, float(at)))
    if best[1] is None:
        return Leaf(float(-rate * total_g / (total_h + 1)))
    f, at = best[1]
    low = x[:, f] <= at
    return Split(f, at, _grow(x[low], g[low], h[low], depth - 1, rate), _grow(x[~low], g[~low], h[~low], depth - 1, rate))


def fit(x: np.ndarray, y: np.ndarray, part: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> Model:
    """Logistic boosting on the rows of part 0; those of part 1 calibrate the scores (Platt scaling); others are left alone."""
    x, y, part = np.asarray(x, float), np.asarray(y, float), np.asarray(part)
    train, calibrate = part == 0, part == 1
    share = float(np.clip(y[train].mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    raw, trees = np.full(train.sum(), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x[train], p - y[train], p * (1 - p), depth, rate)
        trees.append(tree)
        raw += _values(tree, x[train])
    model = Model(bias, tuple(trees))
    held, target = model.raw(x[calibrate]), y[calibrate]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge, so that separable rows stay finite
        p = 1 / (1 + np.exp(-(a * held + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - target) * held).sum() + 0.1 * (a - 1), (p - target).sum() + 0.1 * b])
        hess = np.array([[(w * held * held).sum() + 0.1, (w * held).sum()], [(w * held).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-8:
            break
    return Model(bias, tuple(trees), a, b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Between the scores that are to pass and those that are not: as many as keep the precision.

    Half way from the lowest score that passes to the next lower one (to 0 if there is none), so that neither
    side lies at the edge; 1 (nothing passes) if no score keeps the precision.
    """
    scores = np.unique(p)[::-1]
    for i in range(len(scores) - 1, -1, -1):
        if y[p >= scores[i]].mean() >= precision:
            return float((scores[i] + (scores[i + 1] if i + 1 < len(scores) else 0.0)) / 2)
    return 1.0
