"""Small boosted trees over integer features, fitted on the driver in plain Python, applied as SQL CASE expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """feature < cut goes left; leaves hold values."""

    feature: str
    cut: float
    left: Tree | float
    right: Tree | float

    def value(self, row: dict[str, float]) -> float:
        node = self.left if row[self.feature] < self.cut else self.right
        return node.value(row) if isinstance(node, Tree) else node

    def column(self, features: Column) -> Column:
        left, right = (n.column(features) if isinstance(n, Tree) else F.lit(n) for n in (self.left, self.right))
        return F.when(features[self.feature] < self.cut, left).otherwise(right)


@dataclass(frozen=True)
class Boosted:
    bias: float
    trees: tuple[Tree, ...]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def raw(self, row: dict[str, float]) -> float:
        return self.bias + sum(t.value(row) for t in self.trees)

    def probability(self, features: Column) -> Column:
        """Calibrated; features: a struct."""
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + t.column(features)
        return 1 / (1 + F.exp(-(self.slope * total + self.shift)))


def fit(rows: Sequence[dict[str, float]], labels: Sequence[int], rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 4, smooth: float = 1.0) -> Boosted:
    """Newton boosting of the log loss; ties between splits go to the first feature and the lowest cut."""
    names, share = sorted(rows[0]), (sum(labels) + 1) / (len(labels) + 2)
    bias = math.log(share / (1 - share))
    score, trees = [bias] * len(rows), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [y - q for y, q in zip(labels, p, strict=True)], [max(1e-6, q * (1 - q)) for q in p]
        tree = _grow(rows, names, g, h, list(range(len(rows))), depth, rate, least, smooth)
        if not isinstance(tree, Tree):
            break
        trees.append(tree)
        score = [s + tree.value(r) for s, r in zip(score, rows, strict=True)]
    return Boosted(bias, tuple(trees))


def _grow(rows, names, g, h, at, depth, rate, least, smooth) -> Tree | float:
    gs, hs = sum(g[i] for i in at), sum(h[i] for i in at)
    best, found = 1e-6, None
    for name in names if depth else ():
        sums: dict[float, list[float]] = {}
        for i in at:
            s = sums.setdefault(rows[i][name], [0.0, 0.0, 0])
            s[0], s[1], s[2] = s[0] + g[i], s[1] + h[i], s[2] + 1
        values, gl, hl, n = sorted(sums), 0.0, 0.0, 0
        for low, high in zip(values, values[1:], strict=False):
            gl, hl, n = gl + sums[low][0], hl + sums[low][1], n + sums[low][2]
            if least <= n <= len(at) - least:
                gain = gl * gl / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs * gs / (hs + smooth)
                if gain > best + 1e-12:
                    best, found = gain, (name, (low + high) / 2)
    if not found:
        return rate * gs / (hs + smooth)
    name, cut = found
    sides = [[i for i in at if (rows[i][name] < cut) == left] for left in (True, False)]
    return Tree(name, cut, *(_grow(rows, names, g, h, s, depth - 1, rate, least, smooth) for s in sides))


def calibrated(model: Boosted, rows: Sequence[dict[str, float]], labels: Sequence[int], precision: float) -> Boosted:
    """A logistic curve over held-out scores, and the lowest threshold at which their precision is reached from there up."""
    raw = [model.raw(r) for r in rows]
    a, b = 1.0, 0.0
    for _ in range(200):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b)))) for x in raw]
        ga = sum((q - y) * x for q, y, x in zip(p, labels, raw, strict=True)) + 0.1 * (a - 1)
        gb = sum(q - y for q, y in zip(p, labels, strict=True))
        haa = sum(q * (1 - q) * x * x for q, x in zip(p, raw, strict=True)) + 0.1
        hab = sum(q * (1 - q) * x for q, x in zip(p, raw, strict=True))
        hbb = sum(q * (1 - q) for q in p) + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    ranked = sorted(((1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b)))), y) for x, y in zip(raw, labels, strict=True)), reverse=True)
    good, threshold = 0, 1.0
    for n, (q, y) in enumerate(ranked, 1):
        good += y
        if good >= precision * n:
            threshold = q
    return Boosted(model.bias, model.trees, a, b, max(0.5, threshold))
