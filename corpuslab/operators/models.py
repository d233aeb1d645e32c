"""Models: Bernoulli naive Bayes, trees, boosting, linear models, clustering, votes."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslab.operators import binned, trees
from corpuslab.operators.features import assemble, class_labels
from corpuslab.plans.storage import written

# ---- Bernoulli naive Bayes ----------------------------------------------------------


class BernoulliNB(Estimator):
    """Binary features in an array column; features above 0 count as present.

    Fitting is one grouped sum: a vector of counts per class, combined map-side.
    The prior is the plain class share.
    """

    def __init__(self, features: str, label: str, smoothing: float = 1.0):
        super().__init__()
        self.features, self.label, self.smoothing = features, label, smoothing

    def _fit(self, df: DataFrame) -> Model:
        ones = F.transform(self.features, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
        rows = (
            df.select(F.col(self.label).alias("label"), array_to_vector(ones).alias("v"))
            .groupBy("label").agg(Summarizer.metrics("sum", "count").summary(F.col("v")).alias("s"))
            .select("label", "s.sum", "s.count").orderBy("label").collect()  # one row per class
        )
        counts = np.array([r["sum"].toArray() for r in rows])
        n = np.array([r["count"] for r in rows], dtype=float)
        theta = (counts + self.smoothing) / (n + 2 * self.smoothing)[:, None]
        return BernoulliNBModel(self.features, [r["label"] for r in rows], theta, n)


class BernoulliNBModel(Model):
    """``theta``: probability of each feature per class; ``counts``: rows per class."""

    def __init__(self, features: str, labels: list, theta: np.ndarray, counts: np.ndarray):
        super().__init__()
        self.features, self.labels, self.theta, self.counts = features, labels, theta, counts

    def _transform(self, df: DataFrame) -> DataFrame:
        weight = (np.log(self.theta) - np.log1p(-self.theta)).T
        base = np.log1p(-self.theta).sum(axis=1) + np.log(self.counts / self.counts.sum())
        labels = np.array(self.labels)

        @F.pandas_udf("prediction int, score double")
        def best(batch: pd.Series) -> pd.DataFrame:
            scores = (np.vstack(batch.to_numpy()) > 0) @ weight + base
            at = scores.argmax(axis=1)
            return pd.DataFrame({"prediction": labels[at], "score": scores[np.arange(len(at)), at]})

        return df.withColumn("__nb", best(F.col(self.features))).withColumns(
            {"prediction": F.col("__nb.prediction"), "score": F.col("__nb.score")}).drop("__nb")

    def probabilities(self, spark) -> DataFrame:
        """(label, pos, p): probability of each feature per class."""
        rows = [(c, j, float(p)) for c, row in zip(self.labels, self.theta) for j, p in enumerate(row)]
        return spark.createDataFrame(rows, "label int, pos int, p double")


def draw_rows(probabilities: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """(label, draw, bits): random rows of binary features from per-class probabilities.

    Draws are dealt out by their numbers. The random number of a cell is a hash of its place, so a
    retried task draws the same.
    """
    spark = probabilities.sparkSession
    arrays = probabilities.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("ps"))
    # one row per class
    arrays = written(arrays.withColumn("class", F.row_number().over(Window.orderBy("label")) - 1), "classes")
    numbers = spark.range(arrays.count() * per_class).select(
        F.expr(f"CAST(id DIV {per_class} AS INT)").alias("class"), F.expr(f"CAST(id % {per_class} AS INT)").alias("draw"))
    draws = numbers.join(F.broadcast(arrays), "class")

    def bit(cell: Column) -> Column:
        place = F.concat_ws("-", F.col("label").cast("string"), F.col("draw").cast("string"), cell["pos"].cast("string"), F.lit(str(seed)))
        unit = F.conv(F.substring(F.md5(place), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
        return (unit < cell["p"]).cast("int")

    return draws.select("label", "draw", F.transform("ps", bit).alias("bits"))


# ---- trees and search over settings -------------------------------------------------


def regression_tree(
    features: str = "features", label: str = "label", max_depth: int = 20, min_leaf: int = 10,
    max_features: float | None = None, min_gain: float = 0.0, seed: int = 42,
):
    """Regression tree; with ``max_features`` a forest of one tree, which can draw features per split."""
    if max_features is None:
        return DecisionTreeRegressor(
            featuresCol=features, labelCol=label, maxDepth=max_depth, minInstancesPerNode=min_leaf,
            minInfoGain=min_gain, seed=seed)
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, numTrees=1, bootstrap=False, featureSubsetStrategy=str(max_features),
        maxDepth=max_depth, minInstancesPerNode=min_leaf, minInfoGain=min_gain, seed=seed)


class GrownTree(Model):
    """A regression tree grown from a binned table, over an array column."""

    def __init__(self, features: str, tree: binned.Grown, edges: list[np.ndarray]):
        super().__init__()
        self.features, self.tree, self.edges = features, tree, edges

    def node(self) -> trees.Node:
        return self.tree.node(self.edges)

    def _transform(self, df: DataFrame) -> DataFrame:
        tree, edges = self.tree, self.edges

        @F.pandas_udf("double")
        def told(batch: pd.Series) -> pd.Series:
            x = np.concatenate(batch.to_list()).reshape(len(batch), len(edges)) if len(edges) and len(batch) else np.empty((len(batch), 0))
            bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
            return pd.Series(np.array(tree.value)[tree.place(bins)])

        given = F.transform(F.col(self.features), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
        return df.withColumn("prediction", told(given))


def _binned_labels(df: DataFrame, features: str, label: str, fold: Column, bins: int) -> tuple[DataFrame, list[np.ndarray]]:
    known = df.filter(F.col(label).isNotNull())
    edges = binned.bin_edges(known, features, bins)
    return binned.binned(known, features, edges, {"y": F.col(label).cast("double"), "fold": fold.cast("int")}), edges


def fit_regression_tree(df: DataFrame, features: str, label: str, setting: binned.Setting, bins: int = 256) -> GrownTree:
    """A tree by least squares over an array column; rows without a label are left out."""
    table, edges = _binned_labels(df, features, label, F.lit(0), bins)
    return GrownTree(features, binned.fit_tree(table, setting, [len(e) + 1 for e in edges]), edges)


# The settings that the search draws from.
SEARCH_SPACE = {
    "max_depth": [2, 4, 8, 10, 20],
    "min_split": [2, 4, 8, 10, 20],
    "min_leaf": [1, 2, 4, 8, 10, 20],
    "features": [0.5, "sqrt", "log2"],
    "alpha": [0.0, 1e-6, 1e-5, 1e-4, 1e-3],
}


def random_search(
    df: DataFrame, features: str, label: str, fold: Column, space: dict = SEARCH_SPACE, n: int = 30, folds: int = 5,
    bins: int = 256, seed: int = 42,
) -> tuple[GrownTree, list[tuple[binned.Setting, float]]]:
    """Cross-validated search over ``n`` random settings by mean squared error.

    ``fold`` numbers the rows' folds from 0. All settings and folds grow together over one binned
    table. Returns the tree of the best setting, the first of equal ones, fitted on all rows, and all
    settings with their errors.
    """
    rng = random.Random(seed)
    settings = [binned.Setting(**{k: rng.choice(v) for k, v in space.items()}, seed=seed) for _ in range(n)]
    table, edges = _binned_labels(df, features, label, fold, bins)
    n_bins = [len(e) + 1 for e in edges]
    errors = binned.cross_validate(table, settings, folds, n_bins)
    best = settings[int(np.nanargmin(errors))]
    return GrownTree(features, binned.fit_tree(table, best, n_bins), edges), list(zip(settings, errors))


# ---- boosting -----------------------------------------------------------------------


# Rounds after which the row weights are written.
WRITE_EVERY = 8


class Samme(Estimator):
    """Multi-class boosting of small trees over an array column.

    Features are binned once. A level of a tree is one pass that adds up weights by node, feature,
    bin and class where the rows are; the last level's sums also tell the tree's error. A row's weight follows
    from the latest trees during the pass, and every ``WRITE_EVERY`` rounds the weights are
    written, so that a round's cost stays the same.
    """

    def __init__(self, features: str, label: str, rounds: int = 60, depth: int = 2, rate: float = 0.5, bins: int = 64):
        super().__init__()
        self.features, self.label, self.rounds, self.depth = features, label, rounds, depth
        self.rate, self.bins = rate, bins

    def _fit(self, df: DataFrame) -> Model:
        labels = class_labels(df, self.label)
        place = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
        known = df.filter(F.col(self.label).isNotNull())
        edges = binned.bin_edges(known, self.features, self.bins)
        n_bins, width = [len(e) + 1 for e in edges], len(edges)
        table = binned.binned(known, self.features, edges, {"y": place[F.col(self.label)], "w": F.lit(0.0)}).persist()
        members: list[tuple[float, binned.Grown]] = []
        errors: list[float] = []

        def log_weight(batch, bins, of):
            w, y = batch.column("w").to_numpy().copy(), batch.column("y").to_numpy()
            for a, tree in of:
                w += a * (np.array(tree.value)[tree.place(bins)] != y)
            return w

        def weighted(batches, of):
            for batch in batches:
                w = log_weight(batch, binned.matrix(batch.column("bins"), width), of)
                yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array(w)], names=["bins", "y", "w"])

        for i in range(self.rounds):
            latest = members[i - i % WRITE_EVERY :]
            if i and not latest:
                before, of = table, members[-WRITE_EVERY:]
                table = written(before.mapInArrow(lambda b, of=of: weighted(b, of), before.schema), "boosting").persist()
                before.unpersist()
            weigh = lambda batch, bins, of=latest: np.exp(log_weight(batch, bins, of))
            tree, error = binned.grow_classes(table, weigh, n_bins, len(labels), self.depth)
            if error <= 1e-12:
                members.append((1.0, tree))
                errors.append(0.0)
                break
            if error >= 1 - 1 / len(labels):
                break
            members.append((self.rate * (math.log((1 - error) / error) + math.log(len(labels) - 1)), tree))
            errors.append(error)
        table.unpersist()
        if not members:
            raise ValueError("the first tree is no better than chance")
        return SammeModel(self.features, labels, [(a, t.node(edges)) for a, t in members], errors)


class SammeModel(Model):
    """``members``: (weight, tree); ``errors``: weighted error of each tree when it was added."""

    def __init__(self, features: str, labels: list, members: list[tuple[float, trees.Node]], errors: list[float]):
        super().__init__()
        self.features, self.labels, self.members, self.errors = features, labels, members, errors

    def _transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``confidence``, the largest class probability."""
        k = len(self.labels)
        whole = sum(a for a, _ in self.members)
        x = F.col("__x")
        rows = df.withColumn("__x", F.col(self.features).cast("array<double>"))
        told = F.array(*[
            F.struct(trees.predict(t, x).cast("double").alias("c"), F.lit(float(a)).alias("a")) for a, t in self.members])
        # one pass over the trees adds each one's vote to all classes
        votes = F.aggregate(told, F.array_repeat(F.lit(0.0), k), lambda sums, e: F.transform(
            sums, lambda v, c: v + F.when(e["c"] == c, e["a"]).otherwise(-e["a"] / (k - 1))))
        rows = rows.withColumn("__v", F.transform(votes, lambda v: v / whole))
        best = F.array_max("__v")
        place = F.array_position("__v", best).cast("int")
        spread = F.aggregate("__v", F.lit(0.0), lambda s, v: s + F.exp(v / (k - 1)))
        return rows.withColumns({
            "prediction": F.element_at(F.array(*[F.lit(v) for v in self.labels]), place),
            "confidence": F.exp(best / (k - 1)) / spread,
        }).drop("__x", "__v")


def pseudo_label(estimator: Samme, labelled: DataFrame, unlabelled: DataFrame, key: str, n: int = 1000):
    """Fit, label the ``n`` most confident unlabelled rows, fit again on both.

    Returns (first model, second model, added rows).
    """
    first = estimator.fit(labelled)
    added = first.transform(unlabelled).orderBy(F.desc("confidence"), key).limit(n)
    both = labelled.select(estimator.features, estimator.label).unionByName(
        added.select(estimator.features, F.col("prediction").alias(estimator.label)))
    return first, estimator.fit(both), added


# ---- linear models ------------------------------------------------------------------


def linear_regression(df: DataFrame, features: list[str], label: str):
    """Least squares from the normal equations, one pass; returns the fitted pyspark.ml model."""
    data = assemble(df, features, "__x")
    return LinearRegression(featuresCol="__x", labelCol=label, solver="normal", regParam=0.0).fit(data)


def lasso(df: DataFrame, features: list[str], label: str, alpha: float = 0.01):
    """L1-penalised least squares: 1/(2n) |y - Xw|^2 + alpha |w|."""
    data = assemble(df, features, "__x")
    return LinearRegression(
        featuresCol="__x", labelCol=label, solver="normal", elasticNetParam=1.0, regParam=alpha, standardization=False
    ).fit(data)


def lasso_select(df: DataFrame, features: list[str], label: str, alpha: float = 0.01, top: int = 5) -> list[tuple[str, float]]:
    """The ``top`` features with the largest non-zero Lasso coefficients on standardised columns.

    The objective depends on the rows through one covariance matrix, so the data are read once
    and coordinate descent runs on that.
    """
    gram, target = standard_moments(df, features, label)
    found = lasso_path(gram, target, alpha)
    kept = [(f, float(w)) for f, w in zip(features, found) if abs(w) > 1e-12]
    return sorted(kept, key=lambda p: (-abs(p[1]), p[0]))[:top]


def lasso_path(gram: np.ndarray, target: np.ndarray, alpha: float, rounds: int = 100_000, tol: float = 1e-12) -> np.ndarray:
    """The w that minimises w'Gw / 2 - t'w + alpha |w|, one coordinate after the other until none moves."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            if gram[j, j] > 1e-12:
                pull = target[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(pull) * max(abs(pull) - alpha, 0.0) / gram[j, j]
        if np.abs(w - before).max(initial=0.0) <= tol * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def standard_moments(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """Covariances of standardised features with each other and with the label, in one pass."""
    cov = moments(df, [*features, label])
    scale = np.sqrt(np.maximum(cov.diagonal()[:-1], 1e-300))
    return cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale


def standardised(df: DataFrame, features: list[str], *others: str) -> DataFrame:
    """Features centred and divided by their population deviation; ``others`` unchanged."""
    row = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(features) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [((F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(features)]
    return df.select(*scaled, *others)


def moments(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Population covariance matrix in one pass; its size depends only on the number of columns."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"]
    return out


def rfe(df: DataFrame, features: list[str], label: str, k: int = 5) -> list[str]:
    """Drop the feature with the smallest standardised coefficient until ``k`` are left.

    Every round is a least-squares fit; all of them come from one covariance
    matrix, so the data are read once.
    """
    gram, target = standard_moments(df, features, label)
    left = list(range(len(features)))
    while len(left) > k:
        w = np.linalg.lstsq(gram[np.ix_(left, left)], target[left], rcond=None)[0]
        left.pop(int(np.argmin(np.abs(w))))
    return [features[i] for i in left]


# ---- clustering ---------------------------------------------------------------------


def kmeans(df: DataFrame, features: str, k: int, seed: int = 42):
    return KMeans(featuresCol=features, k=k, seed=seed).fit(df)


def lloyd(df: DataFrame, key: str, features: str, centres: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray, float]:
    """k-means rounds from given centres over an array column: (key, cluster) rows, last centres, inertia.

    Each round sums the rows of a cluster where they are; a cluster without rows keeps its
    centre. Of equally near centres the first one is taken.
    """
    data = written(df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x")), "points")
    width = centres.shape[1]

    def nearest(batch, at):
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        far = ((x[:, None] - at[None]) ** 2).sum(axis=2) if len(x) else np.zeros((0, len(at)))
        return x, far.argmin(axis=1), far.min(axis=1, initial=np.inf)

    def step(at):
        def run(batches):
            sums = np.zeros((len(at), width + 2))
            for batch in batches:
                x, cluster, far = nearest(batch, at)
                np.add.at(sums, cluster, np.column_stack([x, np.ones(len(x)), far]))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["cluster", "s"])

        rows = data.mapInArrow(run, "cluster int, s array<double>").groupBy("cluster").agg(Summarizer.sum(array_to_vector("s")).alias("s"))
        out = np.zeros((len(at), width + 2))
        for r in rows.collect():  # one row per cluster
            out[r["cluster"]] = r["s"].toArray()
        return out

    at = np.array(centres, float)
    for _ in range(rounds):
        sums = step(at)
        some = sums[:, width] > 0
        at = np.where(some[:, None], sums[:, :width] / np.maximum(sums[:, width : width + 1], 1), at)
    inertia = float(step(at)[:, width + 1].sum())

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(nearest(batch, at)[1], pa.int32())], names=["key", "cluster"])

    kind = df.schema[key].dataType.simpleString()
    return data.mapInArrow(assign, f"key {kind}, cluster int"), at, inertia


def choose_k(df: DataFrame, features: str, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette) of k-means over an array column for each number of clusters."""
    from corpuslab.operators.quality import squared_silhouettes

    data = written(df.select(F.col(features).cast("array<double>").alias("x")).withColumn("v", array_to_vector("x")), "points")
    rows = []
    for k in ks:
        model = kmeans(data, "v", k, seed)
        labelled = model.transform(data).select("x", F.col("prediction").alias("label"))
        score = squared_silhouettes(labelled, "x", "label").agg(F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).first()[0]
        rows.append((k, float(model.summary.trainingCost), float(score)))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def elbow(df: DataFrame, features: str, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, inertia) for each number of clusters."""
    data = df.select(features).persist()
    rows = [(k, float(kmeans(data, features, k, seed).summary.trainingCost)) for k in ks if k > 1]
    if 1 in ks:  # one cluster: squared distances to the mean
        n, spread = data.agg(F.count(F.lit(1)), Summarizer.variance(F.col(features))).first()
        rows.append((1, float(spread.toArray().sum() * (n - 1))))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def pca(df: DataFrame, features: str, k: int = 2, out: str = "pca"):
    """Centred principal components: (rows with ``out``, shares of explained variance)."""
    centre = StandardScaler(inputCol=features, outputCol="__c", withMean=True, withStd=False).fit(df)
    rows = centre.transform(df)
    model = PCA(k=k, inputCol="__c", outputCol=out).fit(rows)
    return model.transform(rows).drop("__c"), [float(v) for v in model.explainedVariance]


# ---- votes --------------------------------------------------------------------------


def majority_vote(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """(item, yes, n, correct): true when more than half of the votes, rounded down, are 1."""
    return votes.groupBy(item).agg(F.sum(vote).alias("yes"), F.count(vote).alias("n")).withColumn(
        "correct", F.col("yes") > F.floor(F.col("n") / 2))
