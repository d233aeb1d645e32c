"""Filters, joins, aggregates and row selections that need more than one DataFrame call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslab.plans.quantiles import exact_quantiles
from corpuslab.plans.skew import attach_stats, hot_keys, join_small_or_salted, salted_join


def frequent_groups(df: DataFrame, keys: list[str], more_than: int, salt_by: list[str]) -> DataFrame:
    """Rows whose key occurs more than ``more_than`` times."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.filter(F.col("__n") > more_than).select(*keys)
    return salted_join(df, kept, keys, hot_keys(counts, keys, "__n"), salt_by, "left_semi")


def split_at_quantile(df: DataFrame, x: str, y: str, q: float) -> DataFrame:
    """Mean and count of ``y`` for rows at or below the quantile of ``x`` and for the rest; NULLs left out."""
    threshold = exact_quantiles(df, {x: [q]})[x][0]
    return (
        df.dropna(subset=[x])
        .groupBy((F.col(x) <= F.lit(threshold)).alias("low"))
        .agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))
    )


def attach_count(df: DataFrame, key: str, out: str, salt_by: list[str]) -> DataFrame:
    """How often each row's key occurs, on the row."""
    return attach_stats(df, [key], salt_by, **{out: F.count(F.lit(1))})


def apply_counts(rows: DataFrame, learned: DataFrame, key: str, value: str, salt_by: list[str], default: int = 1) -> DataFrame:
    """Counts learned on one table, put on another; unseen keys get ``default``."""
    joined = join_small_or_salted(rows, learned.select(key, value), [key], salt_by, "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(default)))


def fill_from_map(
    rows: DataFrame, learned: DataFrame, key: str, target: str, salt_by: list[str], default: str
) -> DataFrame:
    """Fill NULLs of ``target`` from a learned map (key, target), then with ``default``."""
    filled = join_small_or_salted(rows, learned.select(key, F.col(target).alias("__learned")), [key], salt_by, "left")
    return filled.withColumn(target, F.coalesce(target, "__learned", F.lit(default))).drop("__learned")


def mode_by_group(df: DataFrame, group: str, value: str, more_than: int) -> DataFrame:
    """(group, value): most frequent value, if it occurs more than ``more_than`` times; ties by value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("b"))
    return best.filter(-F.col("b.neg") > more_than).select(group, F.col("b.v").alias(value))


def value_counts(df: DataFrame, col: str, by_value: bool = False) -> DataFrame:
    """(value, n) by falling count, or by value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("value") if by_value else counts.orderBy(F.desc("n"), "value")


def _plain_zero(df: DataFrame, name: str) -> Column:
    """0.0 for -0.0, which equal each other but differ as text."""
    c = F.col(name)
    return F.when(c == 0, F.lit(0).cast(df.schema[name].dataType)).otherwise(c) if dict(df.dtypes)[name] in ("double", "float") else c


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, n_unique) by falling count, NULLs left out.

    The exact form de-duplicates (column, value) pairs first, so no group holds
    more than its distinct values and counts are combined before the shuffle.
    """
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return row.unpivot([], columns, "column", "n_unique").orderBy(F.desc("n_unique"), "column")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _plain_zero(df, c).cast("string").alias("v")) for c in columns])).alias("p"))
    found = pairs.select("p.column", "p.v").distinct().groupBy("column").agg(F.count("v").alias("n_unique"))
    return found.orderBy(F.desc("n_unique"), "column")


def first_per_class(df: DataFrame, label: str, key: str, payload: list[str]) -> DataFrame:
    """The row with the smallest key of each class, by aggregation rather than a window."""
    best = F.min(F.struct(key, *payload)).alias("b")
    return df.groupBy(label).agg(best).select(label, "b.*")


def extremes(df: DataFrame, value: str, key: str) -> DataFrame:
    """One row: key of the largest and of the smallest value (ties: smallest key). NULL is no value."""
    df = df.filter(F.col(value).isNotNull())
    low = F.min(F.struct(F.col(value).alias("v"), F.col(key).alias("k"))).alias("low")
    high = F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("high")
    return df.agg(low, high).select(F.col("high.k").alias("argmax"), F.col("low.k").alias("argmin"))


def running_share(df: DataFrame, group: str, order: str, flag: Column, out: str) -> DataFrame:
    """Running sum of a flag over the row number, for groups of bounded size such as result lists."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(flag).over(w) / F.count(F.lit(1)).over(w))


__all__ = [
    "apply_counts", "attach_count", "distinct_counts", "extremes", "fill_from_map", "first_per_class",
    "frequent_groups", "mode_by_group", "running_share", "split_at_quantile", "value_counts",
]
