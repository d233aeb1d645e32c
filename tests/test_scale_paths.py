"""The ways taken at scale, forced on small tables: buckets, cells of quantiles, gaps, salts, dictionaries."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslab.operators import features as fe, graph, grid, index as ix, models, trees
from corpuslab.plans import buckets, quantiles, skew, storage
from tests.conftest import rows


# ---- buckets


def test_rounds_shuffle_only_their_own_rows(spark):
    known = buckets.Buckets(spark.range(50).withColumn("hops", F.lit(0)), "id", "reached")
    known.add(spark.range(50, 80).withColumn("hops", F.lit(1)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(40, 120).select((F.col("id") * 1).alias("id")).distinct().join(known.read().select("id"), "id", "left_anti")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "bucket" in plan.lower()
        summed = known.read().groupBy("id").agg(F.min("hops"))
        assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
        assert rows(left) == [(i,) for i in range(80, 120)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    name = known.name
    assert rows(known.close(), "id") == [(i,) for i in range(80)]
    assert not spark.catalog.tableExists(name)


def test_buckets_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(buckets, "COMPACT", 3)
    known = buckets.Buckets(spark.range(4), "id", "rows")
    for i in range(1, 8):
        known.add(spark.range(4 * i, 4 * i + 4))
    assert rows(known.read()) == [(i,) for i in range(32)]
    assert len(known.read().inputFiles()) <= 3 * known.n
    known.close()


@pytest.mark.parametrize("delta", [None, 1, 3, 100])
def test_shortest_paths_by_interval(spark, delta):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)): rng.randint(1, 9) for _ in range(120)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight long")
    dist = {0: 0}
    while True:
        new = dict(dist)
        for (a, b), w in edges.items():
            if a in dist and dist[a] + w < new.get(b, 10**9):
                new[b] = dist[a] + w
        if new == dist:
            break
        dist = new
    got = graph.shortest_paths(df, spark.range(1).select("id"), delta=delta).collect()
    assert {r["id"]: r["dist"] for r in got} == dist
    for r in got:
        before = sorted(a for (a, b), w in edges.items() if b == r["id"] and a in dist and dist[a] + w == dist[b])
        assert r["pred"] == (None if r["id"] == 0 else before[0])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("paths_")]


# ---- tables of a scope


def test_scratch_tables_are_removed_and_results_stay(spark):
    import os

    def path(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://").removeprefix("file:"))

    with storage.scratch(spark) as scope:
        used = storage.written(spark.range(9), "used")
        with storage.scratch(spark) as inner:
            again = storage.written(used.filter("id > 3"), "again")
            kept_inside = inner.result(again, "inside")
        assert os.path.isdir(path(used)) and not os.path.isdir(os.path.dirname(path(kept_inside)) + "/again")
        out = scope.result(kept_inside.filter("id > 5"), "out")
        gone = [path(used), path(kept_inside)]
    assert rows(out) == [(6,), (7,), (8,)]
    assert not any(os.path.isdir(p) for p in gone[:1])
    after = storage.written(spark.range(2), "after")
    assert rows(after) == [(0,), (1,)]


# ---- quantiles


@pytest.mark.parametrize("cuts", [3, 256])
def test_cells_are_cut_until_they_are_small(spark, cuts, monkeypatch):
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=700), np.full(400, 0.25), [-1e300, 1e300], np.round(rng.normal(size=300), 1)])
    df = spark.createDataFrame([(float(v), float(v) if i % 3 else None, 1.0) for i, v in enumerate(values)], "a double, b double, c double").repartition(3)
    probs = [i / 40 for i in range(41)]
    got = quantiles.exact_quantiles(df, {"a": probs, "b": probs, "c": [0.3]}, 5)
    assert got["a"] == pytest.approx(list(np.quantile(values, probs)))
    assert got["b"] == pytest.approx(list(np.quantile([v for i, v in enumerate(values) if i % 3], probs)))
    assert got["c"] == [1.0]


# ---- gaps of cell tables


@pytest.mark.parametrize("block", [4096, 2])
def test_first_gap_equals_scan(spark, block, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK_ROWS", block)
    rng = random.Random(6)
    sizes = {s: (rng.randint(0, 7), rng.randint(0, 5)) for s in range(14)}
    filled = {}
    for s, (h, w) in sizes.items():
        full = rng.randint(0, h * w)
        for i in range(h * w):
            if i < full or rng.random() < 0.5:
                filled[s, i // w, i % w] = "" if rng.random() < 0.03 else "x"
    cells = spark.createDataFrame([(*k, v) for k, v in filled.items()], "sheet_id int, row_idx long, col_idx long, value string")
    sheets = spark.createDataFrame([(s, h, w) for s, (h, w) in sizes.items()], "sheet_id int, n_rows long, n_cols long")
    for r, c in (((None, None), (None, None)), ((1, 3), (0, 2)), ((0, 0), (1, None)), ((2, None), (None, 1))):
        want = []
        for s, (h, w) in sizes.items():
            inside = [(i, j) for i in range(r[0] or 0, min(h, h if r[1] is None else r[1] + 1)) for j in range(c[0] or 0, min(w, w if c[1] is None else c[1] + 1))]
            empty = [p for p in inside if not filled.get((s, *p))]
            want += [(s, *empty[0])] if empty else []
        assert rows(grid.first_gap(cells, sheets, r, c)) == sorted(want)


# ---- salts, dictionaries, lists


def test_every_key_above_the_limit_is_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    counts = spark.createDataFrame([(f"k{i}", 10 * (i + 1)) for i in range(20)], "k string, n long")
    got = dict(rows(skew.hot_keys(counts, ["k"], "n", min_rows=20, rows_per_salt=100)))
    # ten keys from 100 rows, and the two heaviest of those from 20
    assert set(got) == {f"k{i}" for i in range(9, 20)} | {"k8", "k7"}
    assert got["k19"] == got["k7"] == skew.SALTS
    big = dict(rows(skew.hot_keys(spark.createDataFrame([("a", 10**9)], "k string, n long"), ["k"], "n")))
    assert big == {"a": 1000}


def test_dictionary_numbers_categories(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("é", 3), (None, 4), ("b", 5)], "c string, n int")
    model = fe.OneHot(["c", "n"]).fit(df)
    assert rows(model.tables["c"], "value", "id") == [("a", 0), ("b", 1), ("é", 2)] and model.sizes == {"c": 3, "n": 5}
    other = spark.createDataFrame([("a", 9), ("new", 1), (None, 1)], "c string, n int")
    got = model.transform(other).select("c", vector_to_array("c_onehot").alias("v"), vector_to_array("n_onehot").alias("w")).collect()
    assert {r["c"]: r["v"] for r in got} == {"a": [1, 0, 0], "new": [0, 0, 0], None: [0, 0, 0]}
    assert [sum(r["w"]) for r in got if r["c"] == "a"] == [0]
    assert rows(model.names(), "column", "id", "name")[0] == ("c", 0, "c_a")


def test_posting_lists_are_cut_by_rows(spark):
    postings = spark.createDataFrame([("t", 7, i % 4) for i in range(25)] + [("u", 1, 1)], "term string, doc_id long, tf int")
    got = ix.posting_lists(postings, rows=10).collect()
    assert sorted((r["term"], r["block"], len(r["postings"])) for r in got) == [("t", 0, 10), ("t", 1, 10), ("t", 2, 5), ("u", 0, 1)]
    assert sum(([p["tf"] for p in r["postings"]] for r in sorted(got, key=lambda r: (r["term"], r["block"])) if r["term"] == "t"), []) == sorted(i % 4 for i in range(25))


# ---- clusters and parts of trees


def test_lloyd_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(40, 3)) + 4 * i for i in range(3)])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, x array<double>").repartition(3)
    start = np.vstack([x[[0, 1, 2]], [[1e6, 1e6, 1e6]]])
    at = start.copy()
    for _ in range(4):
        near = ((x[:, None] - at) ** 2).sum(2).argmin(1)
        at = np.array([x[near == k].mean(0) if (near == k).any() else at[k] for k in range(4)])
    far = ((x[:, None] - at) ** 2).sum(2)
    found, centres, inertia = models.lloyd(df, "id", "x", start, 4)
    assert np.allclose(centres, at) and inertia == pytest.approx(far.min(1).sum())
    assert dict(rows(found)) == dict(enumerate(far.argmin(1).tolist()))


def test_parts_with_and_without_tables(monkeypatch):
    rng = np.random.default_rng(8)

    def grow(depth):
        if depth == 0 or rng.random() < 0.1:
            return trees.Node(float(rng.normal()), 0.0)
        node = trees.Node(0.0, 0.0, int(rng.integers(5)), float(rng.normal()))
        node.left, node.right = grow(depth - 1), grow(depth - 1)
        return node

    def cover(node, n):
        node.cover = float(n)
        if node.feature >= 0:
            part = float(rng.integers(1, 9)) / 10
            cover(node.left, n * part)
            cover(node.right, n * (1 - part))

    root = grow(7)
    cover(root, 1000.0)
    x = rng.normal(size=(50, 5))
    with_tables = trees.attributions(trees.leaf_groups(trees.leaves(root)), x)
    monkeypatch.setattr(trees, "PATTERN_FEATURES", 0)
    monkeypatch.setattr(trees, "PAIRS", 64)
    assert np.allclose(trees.attributions(trees.leaf_groups(trees.leaves(root)), x), with_tables)
