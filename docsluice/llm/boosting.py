"""Small gradient-boosted trees: fitted on a few thousand rows, applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1  #: -1: a leaf
    at: float = 0.0
    left: Node | None = None  #: rows whose feature is at most `at`
    right: Node | None = None


@dataclass
class Boosted:
    base: float
    trees: list[Node]
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _apply(tree, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability from feature columns."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _expression(tree, features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * total + F.lit(self.offset))))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.at
    out = np.empty(len(x))
    out[low], out[~low] = _apply(node.left, x[low]), _apply(node.right, x[~low])
    return out


def _expression(node: Node, features: list[Column]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(features[node.feature] <= F.lit(node.at), _expression(node.left, features)).otherwise(_expression(node.right, features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Node:
    leaf = Node(value=float(rate * g.sum() / (h.sum() + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    whole, best = g.sum() ** 2 / (h.sum() + ridge), (1e-6, -1, 0.0)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, cg, ch = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            gain = cg[cut] ** 2 / (ch[cut] + ridge) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + ridge) - whole
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), k, float((v[cut[j]] + v[cut[j] + 1]) / 2))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    side = [_grow(x[m], g[m], h[m], depth - 1, least, ridge, rate) for m in (low, ~low)]
    return Node(0.0, best[1], best[2], *side)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, least: int = 8, ridge: float = 1.0, rate: float = 0.3) -> Boosted:
    """Fit on two thirds of the rows by logistic loss, calibrate slope and offset on the rest."""
    held = np.arange(len(x)) % 3 == 2
    fx, fy = x[~held], y[~held].astype(float)
    share = (fy.sum() + 1) / (len(fy) + 2)
    model = Boosted(float(np.log(share / (1 - share))), [])
    margin = model.margin(fx)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(fx, fy - p, p * (1 - p), depth, least, ridge, rate)
        model.trees.append(tree)
        margin += _apply(tree, fx)
    z, t = model.margin(x[held]), y[held].astype(float)
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps with a prior that keeps the slope near one
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p)
        grad = np.array([((p - t) * z).sum() + (a - 1), (p - t).sum() + b * 0.1])
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    model.slope, model.offset = float(max(a, 0.05)), float(b)
    return model


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Smallest probability from which on at least `precision` of the rows are positive; above one if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)  # a threshold takes all rows of equal probability
    ok = np.flatnonzero((right >= precision) & last)
    return float(p[order][ok[-1]]) if len(ok) else 1.1
