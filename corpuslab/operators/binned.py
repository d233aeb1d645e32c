"""Trees grown from histograms of one binned table.

Features are cut into at most 256 bins once; afterwards a row is a string of bytes, one per
feature. A level of a tree needs, for each node, feature and bin, sums over its rows: weights by class
for classification, count, sum and sum of squares for regression. Tasks add up dense histograms
of their rows, Spark adds up those of tasks, and the best split of each node follows.

Regression trees of any number of settings and folds grow together, from the sums of the rows that share all bins and
the fold: cells. Nodes of many cells are split level by level over the whole table. A node of at most
``LOCAL_ROWS`` cells is finished by one task, which gets its cells packed, and so are the cells held out of its
fold, to measure the error.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from corpuslab.operators import trees
from corpuslab.plans.storage import written

MOST_BINS = 256
ACCURACY = 10_000
# Cells of a node that one task may finish by itself.
LOCAL_ROWS = 1_000_000
# Cells that all trees of a search send to tasks at once; further trees grow after them.
TOGETHER_ROWS = 100_000_000


# ---- bins ---------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: str, bins: int = 64) -> list[np.ndarray]:
    """Ascending split points of each entry of an array column.

    An entry with few values has all of them but the largest, another one its quantiles. A row
    is in bin i of an entry when i edges are below it; NULL and NaN are above all.
    """
    width = df.agg(F.max(F.size(features))).first()[0] or 0
    entry = [F.get(F.col(features), F.lit(i)).cast("double") for i in range(width)]
    if not width:
        return []
    distinct = df.agg(*[F.approx_count_distinct(c).alias(str(i)) for i, c in enumerate(entry)]).first()
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[
        (F.sort_array(F.collect_set(c)) if distinct[i] <= bins * 0.9 else F.percentile_approx(c, shares, ACCURACY)).alias(str(i))
        for i, c in enumerate(entry)]).first()
    out = []
    for i in range(width):
        values = np.unique(np.array([v for v in row[i] or [] if v == v], float))
        out.append(values[:-1] if distinct[i] <= bins * 0.9 else values)
    return out


def binned(df: DataFrame, features: str, edges: list[np.ndarray], keep: dict[str, Column]) -> DataFrame:
    """Write (bins, ``keep``): the bins of each row as bytes."""
    given = df.select(F.transform(F.col(features), lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("x"),
                      *[c.alias(n) for n, c in keep.items()])
    schema = "bins binary, " + ", ".join(f"`{n}` {given.schema[n].dataType.simpleString()}" for n in keep)
    width, names = len(edges), ["bins", *keep]

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            bins = np.empty((batch.num_rows, width), np.uint8)
            for i, e in enumerate(edges):
                bins[:, i] = np.searchsorted(e, x[:, i], side="left")
            rows = pa.Array.from_buffers(pa.binary(width), batch.num_rows, [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[1:]], names=names)

    return written(given.mapInArrow(run, schema), "binned")


def matrix(column, width: int) -> np.ndarray:
    """The bins of a batch, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


# ---- trees --------------------------------------------------------------------------


@dataclass
class Grown:
    """A tree over bins: rows of a node with bin <= ``cut`` of ``feature`` go left. -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, v in zip((self.feature, self.cut, self.left, self.right, self.value, self.cover), (-1, 0, -1, -1, value, cover)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, left: int, right: int) -> None:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, right

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = (np.array(c, np.int64) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(bins[inner, feature[node]] <= cut[node], left[node], right[node])

    def node(self, edges: list[np.ndarray], at: int = 0) -> trees.Node:
        """The tree over the features themselves."""
        here = trees.Node(float(self.value[at]), float(self.cover[at]))
        if self.feature[at] >= 0:
            here.feature, here.threshold = self.feature[at], float(edges[self.feature[at]][self.cut[at]])
            here.left, here.right = self.node(edges, self.left[at]), self.node(edges, self.right[at])
        return here


# ---- classification -----------------------------------------------------------------


def class_histograms(table: DataFrame, weigh, grown: Grown, leaves: list[int], n_bins: list[int], classes: int) -> np.ndarray:
    """Weights by (node, feature, bin, class) for the ``leaves`` of a tree.

    ``weigh(batch, bins)`` gives the weights of a batch of ``table`` (bins, y, ...). The array's size
    does not depend on the rows.
    """
    width, most = len(n_bins), max(n_bins)
    size = most * classes

    def run(batches):
        total = np.zeros((len(leaves), width, size))
        number = {leaf: i for i, leaf in enumerate(leaves)}
        for batch in batches:
            bins = matrix(batch.column("bins"), width)
            at = grown.place(bins)
            node = np.array([number.get(i, -1) for i in range(len(grown.feature))])[at]
            use = node >= 0
            node, weight, y = node[use], weigh(batch, bins)[use], batch.column("y").to_numpy()[use]
            for f in range(width):
                key = node * size + bins[use, f].astype(np.int64) * classes + y
                total[:, f] += np.bincount(key, weight, len(leaves) * size).reshape(len(leaves), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(leaves)), pa.int32()), pa.array(list(total.reshape(len(leaves), -1)), pa.list_(pa.float64()))], names=["node", "h"])

    sums = table.mapInArrow(run, "node int, h array<double>").groupBy("node").agg(Summarizer.sum(array_to_vector("h")).alias("h")).collect()
    out = np.zeros((len(leaves), width, most, classes))
    for r in sums:
        out[r["node"]] = r["h"].toArray().reshape(width, most, classes)
    return out


def grow_classes(table: DataFrame, weigh, n_bins: list[int], classes: int, depth: int) -> tuple[Grown, float]:
    """A tree by Gini impurity, and the share of the weight that it puts in the wrong class.

    Ties go to the first feature and bin; a leaf's value is its heaviest class, the first of equal ones.
    """
    grown = Grown()
    grown.add(0.0, 0.0)
    leaves, settled, total = [0], 0.0, 0.0
    for level in range(depth):
        h = class_histograms(table, weigh, grown, leaves, n_bins, classes)
        below = h.cumsum(axis=2)
        whole = below[:, :, -1:]
        above = whole - below
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = (below**2).sum(-1) / below.sum(-1) + (above**2).sum(-1) / above.sum(-1)
            before = (whole[:, 0, 0] ** 2).sum(-1) / whole[:, 0, 0].sum(-1)
        pure = np.where((below.sum(-1) > 0) & (above.sum(-1) > 0), pure, -np.inf)
        following = []
        for i, leaf in enumerate(leaves):
            mass = whole[i, 0, 0]
            if level == 0:
                total = float(mass.sum())
            grown.value[leaf], grown.cover[leaf] = float(mass.argmax()), float(mass.sum())
            # sums arrive in any order, so gains that differ in the last digits are ties
            gain = pure[i] - before[i]
            best = gain.max()
            if not best > 1e-9 * max(mass.sum(), 1e-300):
                settled += float(mass.max())
                continue
            f, cut = (int(x) for x in np.argwhere(gain >= best * (1 - 1e-9))[0])
            sides = [grown.add(float(m[i, f, cut].argmax()), float(m[i, f, cut].sum())) for m in (below, above)]
            grown.split(leaf, f, cut, *sides)
            if level + 1 == depth:
                settled += float(below[i, f, cut].max() + above[i, f, cut].max())
            following += sides
        leaves = following
        if not leaves:
            break
    return grown, (total - settled) / total if total else 0.0


# ---- regression ---------------------------------------------------------------------


@dataclass(frozen=True)
class Setting:
    """How a regression tree may grow. ``features`` is a share, "sqrt", "log2" or None for all at each node."""

    max_depth: int = 20
    min_split: int = 2
    min_leaf: int = 1
    features: float | str | None = None
    alpha: float = 0.0
    seed: int = 42

    def per_node(self, width: int) -> int:
        if self.features is None:
            return width
        if isinstance(self.features, str):
            return max(1, int({"sqrt": np.sqrt, "log2": np.log2}[self.features](width)))
        return max(1, int(self.features * width))


def allowed(setting: Setting, path: np.ndarray, width: int) -> np.ndarray:
    """Which features each node may split by; a node's draw depends on its place in the tree only."""
    k = setting.per_node(width)
    if k >= width:
        return np.ones((len(path), width), bool)
    x = (path.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)) + np.uint64(setting.seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.argsort(np.argsort(x ^ (x >> np.uint64(31)), axis=1), axis=1) < k


def best_splits(h: np.ndarray, setting: Setting, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, left sums) by least squares for nodes with histograms (node, feature, bin, 3); feature -1 for none."""
    below = h.cumsum(axis=2)
    whole = below[:, :, -1:]
    above = whole - below
    n, s = whole[:, 0, 0, 0], whole[:, 0, 0, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below[..., 1] ** 2 / below[..., 0] + above[..., 1] ** 2 / above[..., 0] - (s**2 / n)[:, None, None]
    fits = (below[..., 0] >= max(1, setting.min_leaf)) & (above[..., 0] >= max(1, setting.min_leaf))
    fits &= allowed(setting, path, h.shape[1])[:, :, None] & (n >= setting.min_split)[:, None, None]
    gain = np.where(fits, gain, -np.inf).reshape(len(h), -1)
    best = gain.max(axis=1)
    # equal gains: the first feature and bin
    at = (gain >= (best * (1 - 1e-9))[:, None]).argmax(axis=1)
    spread = whole[:, 0, 0, 2] - s**2 / np.maximum(n, 1)
    some = (best > 0) & (best > 1e-9 * spread) & (spread > 1e-9 * np.maximum(whole[:, 0, 0, 2], 1e-300))
    feature, cut = np.where(some, at // h.shape[2], -1), at % h.shape[2]
    return feature, cut, below[np.arange(len(h)), np.maximum(feature, 0), cut]


def sums_of(node: np.ndarray, n_nodes: int, bins: np.ndarray, weights: list[np.ndarray | None], most: int) -> np.ndarray:
    """The sum of each weight, None for one, by (node, feature, bin)."""
    h = np.empty((n_nodes, bins.shape[1], most, len(weights)))
    for f in range(bins.shape[1]):
        key = node * most + bins[:, f]
        for k, weight in enumerate(weights):
            h[:, f, :, k] = np.bincount(key, weight, n_nodes * most).reshape(n_nodes, most)
    return h


@dataclass
class Part:
    """A subtree with the sums of its nodes and the place of its root in the whole tree."""

    tree: Grown
    sums: list[tuple[float, float, float]]


def grow_local(bins: np.ndarray, moments: np.ndarray, setting: Setting, path: int, n_bins: list[int]) -> Part:
    """Grow the subtree at ``path`` (1 for the root, 2 p and 2 p + 1 below p) from its cells, level by level.

    ``moments``: count, sum and sum of squares of each cell's rows.
    """
    most = max(n_bins, default=1)
    start = tuple(float(x) for x in moments.sum(axis=0))
    part = Part(Grown(), [start])
    part.tree.add(start[1] / start[0] if len(bins) else 0.0, start[0])
    paths, level, depth = np.array([path]), [0], int(path).bit_length() - 1
    at = np.zeros(len(bins), np.int64)  # the cell's place in level, -1 once in a leaf
    while level and depth < setting.max_depth and len(bins):
        use = at >= 0
        bins, moments, at = bins[use], moments[use], at[use]
        # nodes are taken in slices, so that their histograms stay small
        step = max(1, (32 << 20) // (24 * most * max(1, len(n_bins))))
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(level) + 1))
        feature = np.empty(len(level), np.int64)
        cut, lefts = np.empty(len(level), np.int64), np.empty((len(level), 3))
        for first in range(0, len(level), step):
            last = min(first + step, len(level))
            rows = order[bounds[first] : bounds[last]]
            h = sums_of(at[rows] - first, last - first, bins[rows], list(moments[rows].T), most)
            feature[first:last], cut[first:last], lefts[first:last] = best_splits(h, setting, paths[first:last])
        following, next_paths, number = [], [], np.full((len(level), 2), -1)
        for i in np.flatnonzero(feature >= 0):
            whole, left = np.array(part.sums[level[i]]), lefts[i]
            sides = []
            for k, sums in enumerate((left, whole - left)):
                number[i, k] = len(following)
                sides.append(part.tree.add(float(sums[1] / sums[0]), float(sums[0])))
                part.sums.append(tuple(sums))
                following.append(sides[-1])
                next_paths.append(2 * int(paths[i]) + k)
            part.tree.split(level[i], int(feature[i]), int(cut[i]), *sides)
        right = bins[np.arange(len(at)), np.maximum(feature[at], 0)] > cut[at]
        at = np.where(feature[at] >= 0, number[at, right.astype(np.int64)], -1)
        paths, level, depth = np.array(next_paths, dtype=np.int64), following, depth + 1
    return part


def prune(tree: Grown, cost: np.ndarray, alpha: float, leaf_cost: dict[int, float] | None = None) -> np.ndarray:
    """Cut nodes whose own cost plus ``alpha`` is not above that of their subtree; the cost of each subtree.

    ``cost`` is a node's squared error over all training rows. Children come after their parents.
    """
    out = cost + alpha
    for leaf, c in (leaf_cost or {}).items():
        out[leaf] = c
    for i in range(len(cost) - 1, -1, -1):
        if tree.feature[i] >= 0:
            below = out[tree.left[i]] + out[tree.right[i]]
            if alpha > 0 and cost[i] + alpha <= below:
                tree.feature[i] = -1
            else:
                out[i] = below
    return out


def _squares(sums: np.ndarray) -> np.ndarray:
    return sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1)


def cells_of(table: DataFrame) -> DataFrame:
    """Write (bins, fold, n, s, q, m2): rows in the same bins and fold count together.

    Splits depend on a row's bins only, so counts, sums of ``y`` and of its squares grow the same tree; ``m2``,
    the squared distance to the cell's mean, measures errors without cancellation.
    """
    y = F.col("y")
    return written(table.groupBy("bins", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("m2")), "cells")


def _moments(batch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in ("n", "s", "q")])


@dataclass
class Forest:
    """Trees of several settings and held-out folds, and what is known of their upper nodes."""

    trees: list[Grown]
    paths: list[dict[int, int]]  # leaf -> place in the whole tree
    sums: list[list[tuple[float, float, float, float]]]  # the last one counts cells

    def closed(self, jobs: list[tuple[Setting, int]], t: int, leaf: int) -> bool:
        """Whether a leaf stays one: no split was found, or it is as deep as the tree may be."""
        path = self.paths[t][leaf]
        return path <= 0 or path.bit_length() - 1 >= jobs[t][0].max_depth


def _upper(table: DataFrame, jobs: list[tuple[Setting, int]], n_bins: list[int]) -> Forest:
    """Split nodes of more than ``LOCAL_ROWS`` cells level by level; what is left fits a task each.

    Splits come to the driver, at most cells / LOCAL_ROWS of them per tree and level.
    """
    width, most = len(n_bins), max(n_bins, default=1)
    counts = {r["fold"]: (float(r["n"] or 0), float(r["s"] or 0), float(r["q"] or 0), float(r["c"])) for r in table.groupBy("fold").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "q")], F.count(F.lit(1)).alias("c")).collect()}  # one row per fold
    forest = Forest([], [], [])
    for setting, fold in jobs:
        sums = tuple(np.sum([v for f, v in counts.items() if f != fold] or [(0.0, 0.0, 0.0, 0.0)], axis=0))
        tree = Grown()
        tree.add(float(sums[1] / sums[0]) if sums[0] else 0.0, float(sums[0]))
        forest.trees.append(tree)
        forest.paths.append({0: 1})
        forest.sums.append([sums])
    while True:
        open_ = [(t, leaf) for t in range(len(jobs)) for leaf in forest.paths[t]
                 if forest.sums[t][leaf][3] > LOCAL_ROWS and not forest.closed(jobs, t, leaf)]
        if not open_:
            return forest
        known = [(t, forest.trees[t], [leaf for u, leaf in open_ if u == t]) for t in sorted({t for t, _ in open_})]
        folds = [fold for _, fold in jobs]
        settings, paths = [s for s, _ in jobs], forest.paths

        def run(batches, known=known, folds=folds):
            totals = {}
            for batch in batches:
                bins = matrix(batch.column("bins"), width)
                moments, fold = _moments(batch), batch.column("fold").to_numpy()
                for t, tree, leaves in known:
                    place = np.full(len(tree.feature), -1)
                    place[leaves] = np.arange(len(leaves))
                    node = np.where(fold != folds[t], place[tree.place(bins)], -1)
                    use = node >= 0
                    h = sums_of(node[use], len(leaves), bins[use], [*moments[use].T, None], most)
                    totals[t] = totals.get(t, 0) + h
            for t, _, leaves in known:
                for i, leaf in enumerate(leaves if t in totals else []):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([t], pa.int32()), pa.array([leaf], pa.int32()),
                        pa.array([totals[t][i].ravel()], pa.list_(pa.float64()))], names=["tree", "leaf", "h"])

        def choose(batches, settings=settings, paths=paths):
            for batch in batches:
                rows = []
                for t, leaf, h in zip(batch.column("tree").to_pylist(), batch.column("leaf").to_pylist(), batch.column("h")):
                    h = h.values.to_numpy().reshape(1, width, most, 4)
                    f, cut, left = best_splits(h, settings[t], np.array([paths[t][leaf]]))
                    rows.append({"tree": t, "leaf": leaf, "feature": int(f[0]), "cut": int(cut[0]), "left": left[0].tolist()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("tree", pa.int32()), ("leaf", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("left", pa.list_(pa.float64()))]))

        from pyspark.ml.functions import vector_to_array

        sums = table.select("bins", "n", "s", "q", "fold").mapInArrow(run, "tree int, leaf int, h array<double>")
        sums = sums.groupBy("tree", "leaf").agg(Summarizer.sum(array_to_vector("h")).alias("h")).select("tree", "leaf", vector_to_array("h").alias("h"))
        for r in sorted(sums.mapInArrow(choose, "tree int, leaf int, feature int, cut int, left array<double>").collect()):
            t, leaf = r["tree"], r["leaf"]
            tree, path = forest.trees[t], forest.paths[t].pop(leaf)
            if r["feature"] < 0:
                forest.paths[t][leaf] = -path  # a leaf for good
                continue
            left = np.array(r["left"])
            sides = []
            for k, sums_k in enumerate((left, np.array(forest.sums[t][leaf]) - left)):
                sides.append(tree.add(float(sums_k[1] / sums_k[0]), float(sums_k[0])))
                forest.sums[t].append(tuple(sums_k))
                forest.paths[t][sides[-1]] = 2 * path + k
            tree.split(leaf, r["feature"], r["cut"], *sides)


def _finish(table: DataFrame, jobs: list[tuple[Setting, int]], forest: Forest, n_bins: list[int], want_trees: bool) -> list[dict]:
    """Finish each node that is left in one task; its cost, the error of its held-out rows and their sums.

    The cells of a node travel packed; of a leaf that stays one, only their sums in each task.
    """
    import pickle

    width = len(n_bins)
    folds = [fold for _, fold in jobs]
    upper, paths, wanted = forest.trees, forest.paths, [s for s, _ in jobs]
    closed = [{leaf for leaf in paths[t] if forest.closed(jobs, t, leaf)} for t in range(len(jobs))]
    totals = [sums[0][0] for sums in forest.sums]
    kind = [("bins", np.uint8, (width,)), ("y", np.float64, (3,)), ("m2", np.float64), ("fold", np.int32)]

    def pack(batches):
        sums: dict[tuple[int, int, bool], np.ndarray] = {}
        for batch in batches:
            bins = matrix(batch.column("bins"), width)
            rows = np.empty(len(bins), kind)
            rows["bins"], rows["y"], rows["fold"] = bins, _moments(batch), batch.column("fold").to_numpy()
            rows["m2"] = batch.column("m2").to_numpy()
            whole = None
            for t, tree in enumerate(upper):
                if len(tree.feature) == 1 and not closed[t]:
                    whole = rows.tobytes() if whole is None else whole
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "leaf": pa.array([0], pa.int32()), "rows": pa.array([whole], pa.binary())})
                    continue
                at = tree.place(bins)
                leaves = np.unique(at)
                for leaf in closed[t].intersection(leaves.tolist()):
                    for test in (False, True):
                        mine = rows[(at == leaf) & ((rows["fold"] == folds[t]) == test)]
                        if len(mine):
                            n, s, _ = mine["y"].T
                            error = mine["m2"] + n * (s / n - tree.value[leaf]) ** 2
                            sums[t, leaf, test] = sums.get((t, leaf, test), 0) + np.array([*mine["y"].sum(axis=0), error.sum()])
                leaves = [leaf for leaf in leaves.tolist() if leaf not in closed[t]]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([t] * len(leaves), pa.int32()), "leaf": pa.array(leaves, pa.int32()),
                    "rows": pa.array([rows[at == leaf].tobytes() for leaf in leaves], pa.binary())})
        for (t, leaf, test), (n, s, q, error) in sums.items():
            one = np.zeros(1, kind)
            one["y"], one["m2"], one["fold"] = (n, s, q), error - n * (s / n - upper[t].value[leaf]) ** 2, folds[t] if test else folds[t] + 1
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "rows": pa.array([one.tobytes()], pa.binary())})

    def finish(batches):
        key, held = None, []

        def out():
            t, leaf = key
            rows = np.frombuffer(b"".join(held), kind)
            test = rows["fold"] == folds[t]
            path, setting = paths[t][leaf], wanted[t]
            if leaf in closed[t]:
                path, setting = 1, Setting(max_depth=0)
            part = grow_local(rows["bins"][~test], rows["y"][~test], setting, path, n_bins)
            cost = prune(part.tree, _squares(np.array(part.sums)) / max(totals[t], 1), wanted[t].alpha)
            n, s, q = rows["y"][test].T
            told = np.array(part.tree.value)[part.tree.place(rows["bins"][test])]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "cost": pa.array([float(cost[0])]),
                "error": pa.array([float((rows["m2"][test] + n * (s / n - told) ** 2).sum())]), "n": pa.array([float(n.sum())]),
                "s": pa.array([float(s.sum())]), "q": pa.array([float(q.sum())]),
                "grown": pa.array([pickle.dumps(part.tree) if want_trees else None], pa.binary())})

        for batch in batches:
            for t, leaf, rows in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "rows"))):
                if key is not None and (t, leaf) != key:
                    yield from out()
                    held = []
                key = t, leaf
                held.append(rows)
        if key is not None:
            yield from out()

    groups = sum(len(p) for p in paths)
    packed = table.mapInArrow(pack, "tree int, leaf int, rows binary")
    dealt = packed.repartition(max(1, min(groups, 10_000)), "tree", "leaf").sortWithinPartitions("tree", "leaf")
    schema = "tree int, leaf int, cost double, error double, n double, s double, q double, grown binary"
    return [r.asDict() for r in dealt.mapInArrow(finish, schema).collect()]  # one row per finished node


def _whole(jobs, forest: Forest, finished: list[dict]) -> Iterator[tuple[Grown, dict, np.ndarray]]:
    """For each tree its upper part, pruned, its finished leaves and the held-out sums of all nodes."""
    for t, (setting, _) in enumerate(jobs):
        tree, rows = forest.trees[t], {r["leaf"]: r for r in finished if r["tree"] == t}
        sums = np.array(forest.sums[t], dtype=float)
        prune(tree, _squares(sums) / max(sums[0][0], 1), setting.alpha, {leaf: r["cost"] for leaf, r in rows.items()})
        test = np.zeros((len(tree.feature), 4))
        for leaf, r in rows.items():
            test[leaf] = r["n"], r["s"], r["q"], r["error"]
        for i in range(len(tree.feature) - 1, -1, -1):
            if tree.left[i] >= 0:
                test[i, :3] = test[tree.left[i], :3] + test[tree.right[i], :3]
                if tree.feature[i] >= 0:
                    test[i, 3] = test[tree.left[i], 3] + test[tree.right[i], 3]
                else:  # cut here: its mean is told for all of its rows
                    n, s, q = test[i, :3]
                    test[i, 3] = q - 2 * tree.value[i] * s + n * tree.value[i] ** 2
        yield tree, rows, test


def cross_validate(table: DataFrame, settings: list[Setting], folds: int, n_bins: list[int]) -> list[float]:
    """The mean over folds of each setting's squared error on the fold held out.

    ``table``: (bins, y, fold) from :func:`binned`, folds 0 to ``folds`` - 1.
    """
    jobs = [(s, f) for s in settings for f in range(folds)]
    cells = cells_of(table)
    # trees that grow together send their cells to tasks at the same time
    together = max(1, TOGETHER_ROWS // max(1, cells.count()))
    errors = []
    for first in range(0, len(jobs), together):
        some = jobs[first : first + together]
        forest = _upper(cells, some, n_bins)
        errors += [test[0, 3] / test[0, 0] if test[0, 0] else float("nan")
                   for _, _, test in _whole(some, forest, _finish(cells, some, forest, n_bins, False))]
        if first + together < len(jobs):
            gc.collect()
            table.sparkSession._jvm.System.gc()  # shuffle files of these trees
    return [float(np.nanmean(errors[i * folds : (i + 1) * folds])) for i in range(len(settings))]


def fit_tree(table: DataFrame, setting: Setting, n_bins: list[int]) -> Grown:
    """One tree from all rows of ``table`` (bins, y, fold); no fold is -1. It has at most 2 ** (max_depth + 1) nodes."""
    import pickle

    jobs, table = [(setting, -1)], cells_of(table)
    forest = _upper(table, jobs, n_bins)
    tree, rows, _ = next(_whole(jobs, forest, _finish(table, jobs, forest, n_bins, True)))
    for leaf, r in sorted(rows.items()):
        below = pickle.loads(r["grown"])  # written by the task above
        if below.feature[0] >= 0:
            shift = [leaf] + [tree.add(below.value[i], below.cover[i]) for i in range(1, len(below.feature))]
            for i in range(len(below.feature)):
                if below.feature[i] >= 0:
                    tree.split(shift[i], below.feature[i], below.cut[i], shift[below.left[i]], shift[below.right[i]])
    return tree
