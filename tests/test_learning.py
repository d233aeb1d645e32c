import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuslab.operators import explain, features as fe, models, profile, quality, topics, trees
from corpuslab.operators.topics import Nmf
from tests.conftest import rows

FRAME = "id long, followers double, region string, tags string, bio string, user string, ts timestamp"


@pytest.fixture(scope="module")
def frame(spark):
    data = [
        (i, None if i % 5 == 0 else float(i), None if i % 4 == 0 else ("north" if i % 2 else "south"),
         None if i % 6 == 0 else f"tag{i % 3}", None if i == 19 else f"bio of {'Oslo' if i % 2 else 'Rome!'}", f"user{i % 3}")
        for i in range(20)
    ]
    return spark.createDataFrame([(*d, None) for d in data], FRAME)


def test_steps_learn_from_training_rows_only(spark, frame):
    test = spark.createDataFrame([(100, None, None, None, "lives in oslo", "stranger", None), (101, 1e9, "east", "tag9", None, "user0", None)], FRAME)
    steps = Pipeline(stages=[
        fe.MedianImputer(["followers"]), fe.ConstantFill(["tags"]), fe.SuffixInference("bio", "region", ["id"], min_support=3),
        fe.LowTailFlag("followers", "low"), fe.ActivityCount("user", "uploads", ["id"]), fe.CyclicTime("ts"), fe.OneHot(["tags", "region"])])
    model = steps.fit(frame)
    found = {r["id"]: r for r in model.transform(test).collect()}
    known = [float(i) for i in range(20) if i % 5]
    assert found[100]["followers"] == float(np.median(known))
    assert found[100]["tags"] == "unknown_tags" and found[101]["tags"] == "tag9"
    assert found[100]["region"] == "north" and found[101]["region"] == "east"
    assert found[100]["uploads"] == 1 and found[101]["uploads"] == 7
    assert found[101]["tags_onehot"].toArray().sum() == 0 and found[100]["tags_onehot"].toArray().sum() == 1
    assert found[100]["hour_sin"] == 0.0 and found[101]["low"] == 0
    alone = model.transform(test.filter("id = 100")).collect()[0]
    assert alone == found[100], "a test row does not depend on other test rows"


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    assert rows(fe.PopStandardScaler(["x", "k"]).fit(df).transform(df), "x_scaled", "k_scaled") == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows(fe.MinMax(["x", "k"]).fit(df).transform(df), "x_scaled", "k_scaled") == [(0.0, 0.0), (1.0, 0.0)]


def test_stratified_sample_size(spark):
    df = spark.range(300).withColumn("label", (F.col("id") % 7).cast("int"))
    got = fe.stratified_sample(df, "label", "id", 100)
    assert got.count() == 100 and got.select("id").distinct().count() == 100


def test_uninformative_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 5)], "id int, x string, k int")
    assert fe.drop_uninformative(df, ["id", "x", "k"]).columns == ["x"]


def test_bins_equal_pandas(spark):
    import pandas as pd

    values = [float(v) for v in np.random.default_rng(3).integers(0, 30, 500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    want = pd.qcut(pd.Series(values), q=10, duplicates="drop", labels=False)
    found = profile.equal_frequency_bin(df, "x", 10)
    assert [b for _, b in rows(found, "id", "bin")] == list(want)
    assert found.agg(F.count("bin")).first()[0] == 500


def test_histogram_equals_numpy(spark):
    values = list(np.random.default_rng(4).normal(size=400))
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = dict(rows(profile.histogram(df, "x", 12)))
    assert [got.get(i, 0) for i in range(12)] == list(np.histogram(values, 12)[0])


def test_topics_put_documents_together_once(spark, monkeypatch):
    """The result on the documents learned from is that of a second pass, without the pass; odd documents included."""
    entries = [(1, "a", 1.0), (1, "b", 0.5), (2, "b", 1.0), (3, "c", 2.0), (3, "a", 0.25), (4, "unknown", 1.0), (None, "c", 1.0)]
    long = spark.createDataFrame(entries, "id long, term string, weight double").repartition(3)
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    passes, plain = [], topics.NmfModel.rows
    monkeypatch.setattr(topics.NmfModel, "rows", lambda self, df: passes.append(1) or plain(self, df))
    model, found = Nmf(words, k=2, max_iter=4).fit_transform(long)
    got = {r["id"]: r["topics"] for r in found.collect()}
    assert len(passes) == 1 and set(got) == {1, 2, 3, None}
    assert got == {r["id"]: r["topics"] for r in model.transform(long).collect()}
    # each document's factors are the best ones: no small step lowers its error
    weights = {i: np.array([sum(w for j, t, w in entries if (j, t) == (i, term)) for term in "abc"]) for i in got}
    for i, w in got.items():
        error = np.sum((weights[i] - np.array(w) @ model.factor) ** 2)
        for step in np.vstack([np.eye(2), -np.eye(2)]) * 1e-3:
            other = np.maximum(0, np.array(w) + step)
            assert error <= np.sum((weights[i] - other @ model.factor) ** 2) + 1e-9


def test_topics_are_non_negative_and_improve(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    weights = fe.TfIdf("doc_id", "text", max_features=200).fit(docs)
    long = weights.transform(docs)
    assert all(abs(r["s"] - 1) < 1e-9 for r in long.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    model = Nmf(weights.vocabulary, k=4, max_iter=6).fit(long)
    assert (model.factor >= 0).all()
    assert all(b <= a + 1e-6 for a, b in itertools.pairwise(model.losses)) and model.losses[-1] < model.losses[0]
    again = model.transform(long).collect()
    assert all(w >= 0 for r in again for w in r["topics"])
    assert model.topic_terms(spark, 3).count() == 12


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 200")


def test_naive_bayes_equals_numpy(spark, vectors):
    model = models.BernoulliNB("embedding", "label").fit(vectors)
    data = vectors.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in data]) > 0
    y = np.array([r["label"] for r in data])
    labels = sorted(set(y))
    theta = np.array([(x[y == c].sum(0) + 1) / ((y == c).sum() + 2) for c in labels])
    score = x @ np.log(theta).T + (~x) @ np.log(1 - theta).T + np.log([(y == c).mean() for c in labels])
    got = [r["prediction"] for r in model.transform(vectors).orderBy("vec_id").collect()]
    assert got == [labels[i] for i in score.argmax(1)]


def test_drawn_rows_follow_the_probabilities(spark):
    p = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 2, 0.3)], "label int, pos int, p double")
    bits = np.array([r["bits"] for r in models.draw_rows(p, 4000).collect()])
    assert bits[:, 0].sum() == 0 and bits[:, 1].all() and abs(bits[:, 2].mean() - 0.3) < 0.03


def test_boosting_and_pseudo_labels(spark, vectors):
    first, second, added = models.pseudo_label(
        models.Samme("embedding", "label", rounds=4), vectors.filter("vec_id % 2 = 0"), vectors.filter("vec_id % 2 = 1"), "vec_id", 20)
    assert added.count() == 20 and 1 <= len(first.members) <= 4
    k = len(first.labels)
    assert all(0 <= e < 1 - 1 / k for e in first.errors)
    top = math.exp(1 / (k - 1)) / (math.exp(1 / (k - 1)) + (k - 1) * math.exp(-1 / (k - 1) ** 2))
    scored = first.transform(vectors).collect()
    assert all(1 / k - 1e-9 <= r["confidence"] <= top + 1e-9 for r in scored)
    assert np.mean([r["prediction"] == r["label"] for r in scored if r["vec_id"] % 2 == 0]) > 1 / k


@pytest.fixture(scope="module")
def lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").limit(1500).select("l_quantity", "l_discount", "l_tax", "l_extendedprice")


NAMES = ["l_quantity", "l_discount", "l_tax"]


def test_lasso_equals_coordinate_descent(lines):
    data = models.standardised(lines, NAMES, "l_extendedprice")
    x = np.array([list(r) for r in data.collect()])
    x, y = x[:, :3], x[:, 3] - x[:, 3].mean()
    w = np.zeros(3)
    for _ in range(200):
        for j in range(3):
            rho = (x[:, j] * (y - x @ w + x[:, j] * w[j])).mean()
            w[j] = np.sign(rho) * max(abs(rho) - 50.0, 0) / (x[:, j] ** 2).mean()
    got = models.lasso(data, NAMES, "l_extendedprice", alpha=50.0).coefficients.toArray()
    assert got == pytest.approx(w, rel=1e-4, abs=1e-3)


def test_elimination_keeps_the_strong_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)) * [1, 10, 0.1, 5]
    y = 3 * x[:, 0] + 0.001 * x[:, 1] + 50 * x[:, 2] + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")
    assert models.rfe(df, ["a", "b", "c", "d"], "y", 2) == ["a", "c"]


def shapley_by_hand(node, x):
    """Exact Shapley values over all feature subsets, for a small tree."""
    def expect(n, known):
        if n.feature < 0:
            return n.value
        if n.feature in known:
            return expect(n.left if x[n.feature] <= n.threshold else n.right, known)
        return (n.left.cover * expect(n.left, known) + n.right.cover * expect(n.right, known)) / n.cover

    d = len(x)
    phi = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            for s in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                phi[i] += weight * (expect(node, {*s, i}) - expect(node, set(s)))
    return phi


def test_tree_attributions(spark, lines):
    rows_ = fe.assemble(lines, NAMES)
    model = models.regression_tree(label="l_extendedprice", max_depth=5, min_leaf=5).fit(rows_)
    found = explain.tree_shap(model.transform(rows_).drop("features"), NAMES, model).limit(40).collect()
    root = trees.export(model)
    for r in found:
        parts = np.array([r[f"phi_{c}"] for c in NAMES])
        assert r["base"] + parts.sum() == pytest.approx(r["prediction"])
        assert parts == pytest.approx(shapley_by_hand(root, [r[c] for c in NAMES]), rel=1e-6, abs=1e-6)


def test_rows_between_the_same_thresholds_are_explained_once(spark, monkeypatch):
    """The explained cells depend on the tree, not on the number of rows; NaN keeps cells of its own."""
    explained = []
    written = explain.written

    def seen(df, label):
        out = written(df, label)
        explained.append((label, out.count()))
        return out

    monkeypatch.setattr(explain, "written", seen)
    node = trees.Node
    root = node(2.0, 4.0, 0, 5.0, node(1.0, 2.0), node(3.0, 2.0, 1, 7.5, node(2.0, 1.0), node(4.0, 1.0)))
    values = [(float(i % 11), float(i % 13) if i % 17 else None) for i in range(2000)]
    df = spark.createDataFrame(values, "a double, b double")
    found = explain.tree_shap(df, ["a", "b"], root).collect()
    groups = trees.leaf_groups(trees.leaves(root))
    want = trees.attributions(groups, np.array([[a, np.nan if b is None else b] for a, b in values]))
    key = lambda r: tuple(-1.0 if v is None else v for v in r)
    got = sorted(((r["a"], r["b"], r["phi_a"], r["phi_b"]) for r in found), key=key)
    assert np.allclose([g[2:] for g in got], [w[2:] for w in sorted(((*v, *p) for v, p in zip(values, want)), key=key)])
    assert ("cells", 6) in explained


def test_linear_attributions_add_up(lines):
    model = models.linear_regression(lines, NAMES, "l_extendedprice")
    weights = [float(w) for w in model.coefficients]
    found = explain.linear_shap(lines, NAMES, weights, float(model.intercept), lines).limit(20).collect()
    for r in found:
        want = sum(w * r[c] for w, c in zip(weights, NAMES)) + model.intercept
        assert r["base"] + sum(r[f"phi_{c}"] for c in NAMES) == pytest.approx(want)


@pytest.mark.parametrize("block_rows", [30, 2000])
def test_silhouette_equals_numpy(spark, vectors, block_rows):
    data = vectors.filter("vec_id < 100").orderBy("vec_id").collect()
    x, y = np.array([r["embedding"] for r in data], dtype=float), np.array([r["label"] for r in data])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        a = dist[i][y == y[i]].sum() / (own - 1) if own > 1 else 0
        b = min(dist[i][y == c].mean() for c in set(y) if c != y[i])
        s.append((b - a) / max(a, b) if own > 1 else 0.0)
    got = quality.silhouette(vectors.filter("vec_id < 100"), "vec_id", "embedding", "label", block_rows).collect()
    assert sum(r["n"] * r["silhouette"] for r in got) / len(x) == pytest.approx(np.mean(s))


@pytest.mark.parametrize("shift", [0.0, 1000.0])
@pytest.mark.parametrize("pairs", [13, 1 << 20])
def test_two_blocks_are_compared_once_for_both(monkeypatch, pairs, shift):
    """Also copies, rows that hardly differ, one far away and some without a cluster."""
    monkeypatch.setattr(quality, "PAIRS", pairs)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(90, 7)) + shift
    x[50:70], x[70:80], x[89] = x[:20], x[:10] + 1e-7, 1e6
    both = pd.DataFrame({"id": np.arange(90), "x": list(x), "c": np.where(np.arange(90) % 17 == 0, np.nan, draw.integers(0, 4, 90))})
    for a, z in ((both[:60], both[60:]), (both, both)):
        got = quality._cluster_sums(a, z, a is z).set_index(["id", "other_c"])["total"]
        want = {
            (i, c): np.linalg.norm(np.vstack(others["x"][others["c"] == c]) - row, axis=1).sum()
            for one, others in ([(a, z)] if a is z else [(a, z), (z, a)])
            for i, row in zip(one["id"], one["x"]) for c in others["c"].dropna().unique()}
        assert got.to_dict() == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    assert tuple(quality.regression(df, "y", "p").first()) == pytest.approx((2 / 3, 2 / 3, 0.75))
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 1)], "y int, p int")
    assert quality.accuracy(labels, "y", "p").first()[0] == pytest.approx(2 / 3)
    assert quality.confusion(labels, "y", "p", wide=True).columns == ["actual", "1"]


def test_clustering_tools(spark, vectors):
    data = vectors.withColumn("v", array_to_vector("embedding"))
    inertia = [r["inertia"] for r in models.elbow(data, "v", [1, 4]).orderBy("k").collect()]
    assert inertia[1] < inertia[0]
    projected, shares = models.pca(data, "v", 2)
    points = np.array([r["pca"].toArray() for r in projected.collect()])
    assert np.allclose(points.mean(0), 0, atol=1e-6) and 0 < sum(shares) <= 1


def test_random_search_returns_each_draw(spark, lines):
    rows_ = lines.withColumn("x", F.array(*[F.col(c).cast("double") for c in NAMES]))
    best, tried = models.random_search(rows_, "x", "l_extendedprice", F.xxhash64("x") % 2, {"max_depth": [1, 4]}, n=2, folds=2)
    assert len(tried) == 2 and all(m > 0 for _, m in tried)


def test_majority(spark):
    votes = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0)], "item int, vote int")
    assert rows(models.majority_vote(votes, "item", "vote"), "item", "correct") == [(1, True), (2, False)]
