"""Additive explanations of linear models and trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpuslab.operators import trees
from corpuslab.plans.skew import join_small_or_salted
from corpuslab.plans.storage import written

# Pairs of a cell and a leaf that one task may explain.
CELL_PAIRS = 50_000_000


def linear_shap(df: DataFrame, features: list[str], weights: list[float], intercept: float, background: DataFrame) -> DataFrame:
    """Add ``phi_<feature>`` = weight * (x - background mean) and ``base``, the mean prediction.

    The parts and the base add up to the prediction of the row.
    """
    row = background.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
    means = [row[f"m{i}"] for i in range(len(features))]
    base = intercept + sum(w * m for w, m in zip(weights, means))
    parts = {f"phi_{c}": F.lit(w) * (F.col(c) - F.lit(m)) for c, w, m in zip(features, weights, means)}
    return df.withColumns({**parts, "base": F.lit(base)})


def tree_shap(df: DataFrame, features: list[str], model) -> DataFrame:
    """Add ``phi_<feature>`` and ``base`` for a fitted regression tree, or its root as a :class:`trees.Node`.

    Rows between the same thresholds of the tree have the same parts. Each such cell is explained once, in tasks of at
    most ``CELL_PAIRS`` pairs of a cell and a leaf, and joined back onto its rows. The tree travels
    to the tasks by broadcast, as arrays of leaf paths by the features they split on.
    """
    root = model if isinstance(model, trees.Node) else trees.export(model)
    base = trees.expected_value(root)
    paths = trees.leaves(root)
    groups = df.sparkSession.sparkContext.broadcast(trees.leaf_groups(paths))
    edges = trees.thresholds(root, len(features))
    names = [f"phi_{c}" for c in features]

    @F.pandas_udf("binary")
    def cell_of(*columns: pd.Series) -> pd.Series:
        place = [np.where(np.isnan(x), -1, np.searchsorted(e, x, side="left")) for x, e in zip((c.to_numpy(dtype=float) for c in columns), edges)]
        return pd.Series([row.tobytes() for row in np.stack(place, axis=1).astype(np.int32)], dtype=object)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = np.frombuffer(b"".join(batch["__cell"]), np.int32).reshape(len(batch), len(features))
            x = np.stack([np.append(e, [np.inf, np.nan])[place[:, i]] for i, e in enumerate(edges)], axis=1)
            yield batch.assign(**dict(zip(names, np.asarray(trees.attributions(groups.value, x)).T)))

    placed = df.withColumn("__cell", cell_of(*[F.col(c).cast("double") for c in features]))
    cells = written(placed.select("__cell").distinct(), "cells")
    tasks = max(1, -(-cells.count() * len(paths) // CELL_PAIRS))
    schema = "__cell binary" + "".join(f", `{n}` double" for n in names)
    parts = written(cells.repartition(tasks).mapInPandas(explain, schema), "parts")
    joined = join_small_or_salted(placed, parts, ["__cell"], df.columns)
    return joined.select(*df.columns, *names, F.lit(base).alias("base"))


def global_importance(explained: DataFrame, features: list[str], top: int | None = 5) -> DataFrame:
    """(feature, importance): mean absolute part, largest first."""
    row = explained.agg(*[F.avg(F.abs(F.col(f"phi_{c}"))).alias(c) for c in features])
    ranked = row.unpivot([], features, "feature", "importance").orderBy(F.desc("importance"), "feature")
    return ranked if top is None else ranked.limit(top)


def local(explained: DataFrame, features: list[str], key: str, prediction: str) -> DataFrame:
    """(which, key, feature, x, phi, position) of the rows with the highest and lowest prediction.

    Both rows are found by aggregation (ties: smallest key, NULL predictions left
    out), then their parts are ordered by absolute size.
    """
    explained = explained.filter(F.col(prediction).isNotNull())
    payload = F.struct(F.col(key), *[F.struct(F.col(c).cast("double").alias("x"), F.col(f"phi_{c}").alias("phi")).alias(c) for c in features])
    picked = explained.agg(
        F.min(F.struct((-F.col(prediction)).alias("v"), F.col(key).alias("k"), payload.alias("row"))).alias("high"),
        F.min(F.struct(F.col(prediction).alias("v"), F.col(key).alias("k"), payload.alias("row"))).alias("low"),
    )
    cells = [
        F.struct(F.lit(which).alias("which"), F.col(f"{which}.row.{key}").alias(key), F.lit(c).alias("feature"),
                 F.col(f"{which}.row.{c}.x").alias("x"), F.col(f"{which}.row.{c}.phi").alias("phi"))
        for which in ("high", "low") for c in features
    ]
    ordered = F.array_sort(
        F.array(*cells), lambda a, b: F.when(F.abs(a["phi"]) > F.abs(b["phi"]), -1).when(
            F.abs(a["phi"]) < F.abs(b["phi"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    rows = picked.select(F.posexplode(ordered).alias("at", "r")).select("at", "r.*")
    # two rows, one part per feature
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("which").orderBy("at"))).drop("at")


def dependence(explained: DataFrame, feature: str, key: str) -> DataFrame:
    """(key, x, phi) of one feature."""
    return explained.select(key, F.col(feature).alias("x"), F.col(f"phi_{feature}").alias("phi"))


def feature_names(numeric: list[str], categories: dict[str, list[str]], topics: int) -> list[str]:
    """Names of assembled columns: numeric, one per category value, one per topic."""
    named = [f"{c}_{v}" for c, values in categories.items() for v in values]
    return [*numeric, *named, *[f"topic{i + 1}" for i in range(topics)]]


def feature_name_table(names: DataFrame, sizes: dict[str, int], numeric: list[str], topics: int) -> DataFrame:
    """(pos, name) of assembled columns, with the categories' ``names`` (column, id, name) left in their table."""
    spark = names.sparkSession
    starts, at = [], len(numeric)
    for column, size in sizes.items():
        starts.append((column, at))
        at += size
    ends = [*enumerate(numeric), *[(at + i, f"topic{i + 1}") for i in range(topics)]]
    first = F.create_map(*[x for c, n in starts for x in (F.lit(c), F.lit(n))])
    middle = names.select((F.col("id") + first[F.col("column")]).cast("int").alias("pos"), "name")
    return middle.unionByName(spark.createDataFrame(ends, "pos int, name string"))
