"""Fitted decision trees as plain data: a SQL expression for prediction, leaf paths for attribution."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


@dataclass
class Node:
    """A node of a fitted tree; ``feature`` is -1 in a leaf. ``cover`` is its weighted row count."""

    value: float
    cover: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def export(model) -> Node:
    """Nodes of a fitted pyspark.ml tree model with continuous features."""
    return _export(model._call_java("rootNode"))


def _export(node) -> Node:
    here = Node(node.prediction(), float(node.impurityStats().count()))
    if node.numDescendants() > 0:
        split = node.split()
        here.feature, here.threshold = split.featureIndex(), split.threshold()
        here.left, here.right = _export(node.leftChild()), _export(node.rightChild())
    return here


def predict(node: Node, features: Column) -> Column:
    """The tree as nested CASE expressions over an array column."""
    if node.feature < 0:
        return F.lit(node.value)
    go_left = F.get(features, F.lit(node.feature)) <= F.lit(node.threshold)
    return F.when(go_left, predict(node.left, features)).otherwise(predict(node.right, features))


@dataclass
class Leaf:
    """Path to a leaf, one entry per distinct feature: share of training rows that
    follow the path's splits on it, and the interval (low, high] that x must be in."""

    value: float
    features: list[int]
    share: list[float]
    low: list[float]
    high: list[float]


def leaves(node: Node) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(n: Node, path: dict[int, tuple[float, float, float]]) -> None:
        if n.feature < 0:
            f = list(path)
            out.append(Leaf(n.value, f, *[[path[i][p] for i in f] for p in range(3)]))
            return
        share, low, high = path.get(n.feature, (1.0, -np.inf, np.inf))
        for child, lo, hi in ((n.left, low, min(high, n.threshold)), (n.right, max(low, n.threshold), high)):
            walk(child, {**path, n.feature: (share * child.cover / n.cover, lo, hi)})

    walk(node, {})
    return out


def thresholds(node: Node, width: int) -> list[np.ndarray]:
    """The distinct thresholds of each feature, ascending."""
    found: list[set[float]] = [set() for _ in range(width)]
    rest = [node]
    while rest:
        n = rest.pop()
        if n.feature >= 0:
            found[n.feature].add(n.threshold)
            rest += [n.left, n.right]
    return [np.array(sorted(f), float) for f in found]


def expected_value(node: Node) -> float:
    """Mean prediction over the training rows."""
    return sum(leaf.value * float(np.prod(leaf.share)) for leaf in leaves(node))


# Leaves with up to so many features have a table of all patterns of passed splits.
PATTERN_FEATURES = 10
# Row and leaf pairs handled at once.
PAIRS = 1 << 20


def _parts(value: np.ndarray, share: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """Shapley values by (..., feature) of leaves with ``share`` (..., d) where ``passed`` (..., d) tells the splits.

    A leaf is reached by a coalition S with weight prod(o_j for j in S) * prod(z_j for j not in S),
    where o_j says whether the row passes the splits on feature j and z_j is the share of training
    rows that do. The sum over coalitions of each size is a coefficient of prod(z_j + o_j t), so one
    polynomial per leaf gives all features: divide out one factor, weight the coefficients by
    the Shapley weights of their sizes.
    """
    share, passed = np.broadcast_arrays(share, passed)
    d = passed.shape[-1]
    poly = np.zeros((*passed.shape[:-1], d + 1))
    poly[..., 0] = 1.0
    for j in range(d):
        grown = poly * share[..., j, None]
        grown[..., 1:] += poly[..., :-1] * passed[..., j, None]
        poly = grown
    weight = np.ones(d)
    for size in range(1, d):
        weight[size] = weight[size - 1] * size / (d - size)
    weight /= d
    out = np.empty(passed.shape)
    for j in range(d):
        z, o = share[..., j], passed[..., j]
        rest, carry = np.zeros(poly.shape[:-1]), np.zeros(poly.shape[:-1])
        for size in range(d - 1, -1, -1):
            # o = 1: synthetic division by (z + t); o = 0: the factor is the constant z
            carry = np.where(o, poly[..., size + 1] - z * carry, 0.0)
            rest += weight[size] * np.where(o, carry, poly[..., size] / z)
        out[..., j] = value * (o - z) * rest
    return out


@dataclass
class LeafGroup:
    """All leaves whose paths split on the same features, as arrays by (leaf, feature)."""

    features: list[int]
    value: np.ndarray
    share: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray | None  # parts by (leaf, pattern, feature); bit j of a pattern is feature j


def leaf_groups(paths: list[Leaf]) -> list[LeafGroup]:
    by_features: dict[tuple[int, ...], list] = {}
    for leaf in paths:
        order = np.argsort(leaf.features)
        key = tuple(np.array(leaf.features, int)[order].tolist())
        if key:
            by_features.setdefault(key, []).append((leaf.value, *[np.array(c)[order] for c in (leaf.share, leaf.low, leaf.high)]))
    out = []
    for key, found in by_features.items():
        value = np.array([f[0] for f in found])
        share, low, high = (np.stack([f[k] for f in found]) for k in (1, 2, 3))
        table, d = None, len(key)
        if d <= PATTERN_FEATURES:
            patterns = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1 == 1
            table = _parts(value[:, None], share[:, None], patterns[None])
        out.append(LeafGroup(list(key), value, share, low, high, table))
    return out


def attributions(groups: list[LeafGroup], x: np.ndarray) -> np.ndarray:
    """Shapley values of a tree for all rows of ``x``, leaves of the same features at once."""
    phi = np.zeros_like(x, dtype=float)
    for g in groups:
        cols, d = x[:, g.features], len(g.features)
        step = max(1, PAIRS // (len(g.value) * d))
        for at in range(0, len(x), step):
            rows = cols[at : at + step, None]
            passed = (rows > g.low) & (rows <= g.high)
            if g.table is not None:
                pattern = passed @ (1 << np.arange(d))
                parts = g.table[np.arange(len(g.value)), pattern].sum(axis=1)
            else:
                parts = _parts(g.value, g.share, passed).sum(axis=1)
            phi[at : at + step, g.features] += parts
    return phi
