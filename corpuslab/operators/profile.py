"""Tables behind exploratory plots: gaps, spread, correlation, binned means, histograms."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from corpuslab.functions import scalar
from corpuslab.operators.relational import distinct_counts, value_counts
from corpuslab.plans.quantiles import exact_quantiles
from corpuslab.plans.ranking import top_k


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, ratio) of NULLs, largest first; one pass."""
    columns = columns or df.columns
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "ratio").orderBy(F.desc("ratio"), "column")


def nunique(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    return distinct_counts(df, columns or df.columns, approximate)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact quartiles and sample deviation."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.lit(quartiles[c][0]).cast("double").alias("q25"),
            F.lit(quartiles[c][1]).cast("double").alias("q50"), F.lit(quartiles[c][2]).cast("double").alias("q75"),
            F.max(c).cast("double").alias("max"))
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def corr_with(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, corr) with the target over rows where both are present."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "corr").orderBy(F.desc("corr"), "column")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for all ordered pairs, in one pass over the data."""
    pairs = list(combinations(columns, 2))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]
    if not pairs:
        return df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, corr double")
    half = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("r")).select("r.*")
    turned = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    same = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, corr double")
    return half.unionByName(turned).unionByName(same)


def equal_frequency_bin(df: DataFrame, x: str, bins: int, out: str = "bin", interval_rows: int | None = None) -> DataFrame:
    """Add the number of the equal-frequency bin of ``x``, from 0; NULL stays NULL.

    Bins are closed on the right, the lowest value is in bin 0, and repeated edges
    are dropped. Bucketizer finds the bin by binary search; it closes bins on the
    left, so it runs on the negated values.
    """
    found = exact_quantiles(df, {x: [i / bins for i in range(bins + 1)]}, interval_rows)[x]
    if found[0] is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    edges = sorted(set(found))
    if len(edges) <= 2:
        return df.withColumn(out, F.when(F.col(x).isNotNull(), F.lit(0)))
    # interpolated outer edges may miss the extremes by a rounding step
    splits = [float("-inf"), *[-e for e in reversed(edges[1:-1])], float("inf")]
    negated = df.withColumn("__neg", -F.col(x).cast("double"))
    binned = Bucketizer(splits=splits, inputCol="__neg", outputCol="__bin", handleInvalid="keep").transform(negated)
    last = len(edges) - 2
    return binned.withColumn(
        out, F.when(F.col(x).isNotNull(), F.lit(last) - F.col("__bin")).cast("int")
    ).drop("__neg", "__bin")


def binned_mean(df: DataFrame, x: str, y: str, bins: int, interval_rows: int | None = None) -> DataFrame:
    """(bin, mean, n) of ``y`` by equal-frequency bins of ``x``."""
    rows = equal_frequency_bin(df.dropna(subset=[x]).select(x, y), x, bins, interval_rows=interval_rows)
    return rows.groupBy("bin").agg(F.avg(y).alias("mean"), F.count(y).alias("n"))


def category_mean(df: DataFrame, category: str, y: str) -> DataFrame:
    return df.dropna(subset=[category]).groupBy(category).agg(F.avg(y).alias("mean"))


def activity_mean(df: DataFrame, user: str, y: str, at_least: int = 5) -> DataFrame:
    """(uploads, mean, n): mean of ``y`` over all rows of users by how many rows they have.

    Works on one row per user: sums and counts add up, so rows need no join.
    """
    per_user = df.groupBy(user).agg(F.count(F.lit(1)).alias("uploads"), F.sum(y).alias("s"), F.count(y).alias("c"))
    return (
        per_user.filter(F.col("uploads") >= at_least)
        .groupBy("uploads")
        .agg((F.sum("s") / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
    )


def time_mean(df: DataFrame, part, y: str, out: str) -> DataFrame:
    """Mean of ``y`` by a time part such as the hour or the day."""
    return df.groupBy(part.alias(out)).agg(F.avg(y).alias("mean"), F.count(y).alias("n")).filter(F.col(out).isNotNull())


def pair_deviation(df: DataFrame, pairs: list[tuple[str, str]], y: str, top: int = 3) -> DataFrame:
    """(left_name, right_name, left_value, right_value, mean, n, delta): combinations farthest from the mean.

    All pairs are grouped in one pass. Values are shown as text. The mean of all
    rows is what they are compared with; rows with a missing value are left out of a pair.
    """
    overall = df.agg(F.avg(y)).scalar()
    both = [
        F.struct(F.lit(a).alias("left_name"), F.lit(b).alias("right_name"),
                 F.col(a).cast("string").alias("left_value"), F.col(b).cast("string").alias("right_value"))
        for a, b in pairs
    ]
    means = (
        df.filter(F.col(y).isNotNull()).select(F.col(y).alias("y"), F.explode(F.array(*both)).alias("p"))
        .filter(F.col("p.left_value").isNotNull() & F.col("p.right_value").isNotNull())
        .groupBy("p.left_name", "p.right_name", "p.left_value", "p.right_value")
        .agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"))
        .withColumn("delta", F.col("mean") - overall)
    )
    order = [F.desc(F.abs("delta")), F.asc("left_value"), F.asc("right_value")]
    return top_k(means, ["left_name", "right_name"], order, top)


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """(bin, n) for equal-width bins between the least and the largest value; the last bin is closed."""
    low, high = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(x) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(x).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return value_counts(df, label, by_value=True)


def shape(df: DataFrame, features: str, label: str) -> DataFrame:
    """One row: rows, features of the widest row, classes."""
    classes = df.select(label).distinct().agg(F.count(label)).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(features)).alias("n_features")).withColumn(
        "n_classes", classes)


def random_subset(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement; the same rows for the same seed."""
    return df.orderBy(scalar.draw_order(key, seed), key).limit(n)
