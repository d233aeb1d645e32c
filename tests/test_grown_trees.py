"""Binned trees, the search over settings and boosting against brute force on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import binned, features, models
from tests.conftest import rows


def table_of(n, seed=1, values=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [float(rng.randrange(values)) for _ in range(3)]
        out.append((i, x, 3 * x[0] - (x[1] > 2) * x[2] + rng.random(), i % 3))
    return out


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(table_of(160), "id long, x array<double>, y double, fold int").repartition(3).cache()


def brute_tree(data, setting, path=1):
    """Split by split over all values; features drawn as the grower draws them."""
    y = np.array([d[1] for d in data])
    node = {"value": y.mean(), "sse": float(((y - y.mean()) ** 2).sum()), "n": len(y)}
    if path.bit_length() - 1 >= setting.max_depth or len(y) < setting.min_split or node["sse"] < 1e-9:
        return node
    use = binned.allowed(setting, np.array([path]), 3)[0]
    best = None
    for f in range(3):
        for v in sorted({d[0][f] for d in data})[:-1]:
            left = [d for d in data if d[0][f] <= v]
            right = [d for d in data if d[0][f] > v]
            if not use[f] or min(len(left), len(right)) < setting.min_leaf:
                continue
            sse = sum(float(((s - s.mean()) ** 2).sum()) for s in (np.array([d[1] for d in side]) for side in (left, right)))
            gain = node["sse"] - sse
            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                best = gain, f, v, left, right
    if best is None:
        return node
    _, f, v, left, right = best
    return node | {"f": f, "v": v, "left": brute_tree(left, setting, 2 * path), "right": brute_tree(right, setting, 2 * path + 1)}


def brute_prune(node, alpha, n):
    if "f" not in node:
        return node["sse"] / n + alpha
    below = brute_prune(node["left"], alpha, n) + brute_prune(node["right"], alpha, n)
    own = node["sse"] / n + alpha
    if alpha > 0 and own <= below:
        del node["f"]
        return own
    return below


def told(node, x):
    while "f" in node:
        node = node["left"] if x[node["f"]] <= node["v"] else node["right"]
    return node["value"]


SETTINGS = [
    binned.Setting(max_depth=4), binned.Setting(max_depth=20, min_leaf=5, min_split=20), binned.Setting(max_depth=8, features="sqrt"),
    binned.Setting(max_depth=8, features=0.7, alpha=1e-2), binned.Setting(max_depth=1), binned.Setting(max_depth=6, alpha=0.05), binned.Setting(max_depth=0)]


@pytest.mark.parametrize("local", [1_000_000, 30, 3])
def test_cross_validation_equals_brute_force(small, local, monkeypatch):
    monkeypatch.setattr(binned, "LOCAL_ROWS", local)
    data = [tuple(r) for r in small.collect()]
    edges = binned.bin_edges(small, "x", 256)
    table = binned.binned(small, "x", edges, {"y": F.col("y"), "fold": F.col("fold")})
    got = binned.cross_validate(table, SETTINGS, 3, [len(e) + 1 for e in edges])
    for setting, mse in zip(SETTINGS, got):
        want = []
        for fold in range(3):
            train = [(x, y) for _, x, y, f in data if f != fold]
            tree = brute_tree(train, setting)
            brute_prune(tree, setting.alpha, len(train))
            want.append(np.mean([(y - told(tree, x)) ** 2 for _, x, y, f in data if f == fold]))
        assert mse == pytest.approx(np.mean(want), rel=1e-9), setting


@pytest.mark.parametrize("local", [1_000_000, 25])
def test_fitted_tree_equals_brute_force(small, local, monkeypatch):
    monkeypatch.setattr(binned, "LOCAL_ROWS", local)
    data = [tuple(r) for r in small.collect()]
    for setting in SETTINGS:
        tree = brute_tree([(x, y) for _, x, y, _ in data], setting)
        brute_prune(tree, setting.alpha, len(data))
        model = models.fit_regression_tree(small, "x", "y", setting)
        got = {r["id"]: r["prediction"] for r in model.transform(small).collect()}
        assert got == pytest.approx({i: told(tree, x) for i, x, _, _ in data})
        node = model.node()
        assert node.value == pytest.approx(np.mean([d[2] for d in data])) and node.cover == len(data)


def test_search_keeps_the_best_setting(small):
    best, tried = models.random_search(small, "x", "y", F.col("fold"), {"max_depth": [0, 5], "min_leaf": [1, 4]}, n=6, folds=3)
    assert len(tried) == 6 and {s.max_depth for s, _ in tried} == {0, 5}
    mse = min(m for _, m in tried)
    deep = [m for s, m in tried if s.max_depth == 5]
    assert mse in deep and best.tree.feature[0] >= 0


def test_edges_of_few_and_many_values(spark):
    df = spark.createDataFrame([([float(i % 4), float(i), None if i % 2 else float("nan")],) for i in range(1000)], "x array<double>")
    few, many, none = binned.bin_edges(df, "x", 16)
    assert few.tolist() == [0.0, 1.0, 2.0] and len(none) == 0
    assert len(many) == 15 and all(abs(e - 1000 * (i + 1) / 16) < 5 for i, e in enumerate(many))
    bins = [list(r["bins"]) for r in binned.binned(df, "x", [few, many, none], {"k": F.lit(1)}).collect()]
    assert {b[0] for b in bins} == {0, 1, 2, 3} and max(b[1] for b in bins) == 15 and {b[2] for b in bins} == {0}


def brute_boost(data, rounds, depth, rate, classes):
    """SAMME with trees by Gini impurity over all values."""
    weight = np.ones(len(data))
    out = []

    def grow(at, level):
        mass = np.bincount([data[i][1] for i in at], weight[at], classes)
        node = {"value": int(mass.argmax())}
        best = None
        if level < depth:
            for f in range(len(data[0][0])):
                for v in sorted({data[i][0][f] for i in at})[:-1]:
                    sides = [np.array([i for i in at if (data[i][0][f] <= v) == side]) for side in (True, False)]
                    pure = sum((m**2).sum() / m.sum() for m in (np.bincount([data[i][1] for i in s], weight[s], classes) for s in sides))
                    gain = pure - (mass**2).sum() / mass.sum()
                    if gain > 1e-9 * mass.sum() and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, v, sides
        if best:
            _, node["f"], node["v"], sides = best
            node["left"], node["right"] = (grow(s, level + 1) for s in sides)
        return node

    for _ in range(rounds):
        tree = grow(np.arange(len(data)), 0)
        missed = np.array([told(tree, x) != y for x, y in data])
        error = weight[missed].sum() / weight.sum()
        if error >= 1 - 1 / classes:
            break
        if error <= 1e-12:
            out.append((1.0, tree))
            break
        a = rate * (np.log((1 - error) / error) + np.log(classes - 1))
        out.append((a, tree))
        weight = weight * np.exp(a * missed)
    return out


@pytest.mark.parametrize("every", [8, 2])
def test_boosting_equals_brute_force(spark, every, monkeypatch):
    monkeypatch.setattr(models, "WRITE_EVERY", every)
    rng = random.Random(5)
    data = []
    for _ in range(90):
        x = [float(rng.randrange(5)) for _ in range(3)]
        data.append((x, (int(x[0] + x[1] > 4) + int(x[2] > 3 and rng.random() < 0.7)) if rng.random() < 0.9 else 2))
    df = spark.createDataFrame([(i, x, 10 * y) for i, (x, y) in enumerate(data)], "id int, x array<double>, label int").repartition(3)
    model = models.Samme("x", "label", rounds=5, depth=2, rate=0.5).fit(df)
    want = brute_boost(data, 5, 2, 0.5, 3)
    assert [a for a, _ in model.members] == pytest.approx([a for a, _ in want])
    votes = {}
    for i, (x, _) in enumerate(data):
        sums = np.zeros(3)
        for a, tree in want:
            sums += np.where(np.arange(3) == told(tree, x), a, -a / 2)
        votes[i] = sums
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    for i, sums in votes.items():
        top = np.sort(sums)
        assert got[i] == 10 * int(sums.argmax()) or top[-1] - top[-2] < 1e-9


def test_too_many_classes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CLASSES", 3)
    df = spark.createDataFrame([([1.0], i) for i in range(20)], "x array<double>, label int")
    with pytest.raises(ValueError):
        models.Samme("x", "label").fit(df)


def _packed_cells(monkeypatch):
    """The numbers of cells that each tree's histograms took, as a search runs."""
    counts = []
    cells_of = binned.cells_of

    def seen(table):
        cells = cells_of(table)
        counts.append(cells.count())
        return cells

    monkeypatch.setattr(binned, "cells_of", seen)
    return counts


def test_search_sends_cells_and_not_rows(spark, monkeypatch):
    """Rows of the same bins and fold travel as one, however many there are."""
    counts = _packed_cells(monkeypatch)
    monkeypatch.setattr(binned, "TOGETHER_ROWS", 40)
    df = spark.range(3000).select(
        F.array((F.col("id") % 4).cast("double"), (F.col("id") % 3).cast("double")).alias("x"), (F.col("id") % 7).cast("double").alias("y"),
        (F.col("id") % 5).cast("int").alias("fold"))
    _, tried = models.random_search(df, "x", "y", F.col("fold"), {"max_depth": [0, 1, 3]}, n=4, folds=5)
    assert counts and max(counts) <= 4 * 3 * 5
    assert all(0 < mse < 5 for _, mse in tried)


def test_leaf_that_stays_one_travels_as_sums(spark, monkeypatch):
    """Neither at the depth limit nor without a split does a task get the cells of a large leaf."""
    monkeypatch.setattr(binned, "LOCAL_ROWS", 10)
    rows = [(i, [float(i), float(i * 7 % 50)], float(i * i % 31), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y double, fold int")
    edges = binned.bin_edges(df, "x", 256)
    cells = binned.cells_of(binned.binned(df, "x", edges, {"y": F.col("y"), "fold": F.col("fold")}))
    jobs, n_bins = [(binned.Setting(max_depth=1), 0)], [len(e) + 1 for e in edges]
    forest = binned._upper(cells, jobs, n_bins)
    assert all(forest.closed(jobs, 0, leaf) for leaf in forest.paths[0])
    found = binned._finish(cells, jobs, forest, n_bins, False)
    assert sum(r["n"] for r in found) == 100  # the rows held out
