"""Model quality: regression errors, accuracy, confusion, silhouette, comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslab.plans.skew import fits_broadcast
from corpuslab.plans.storage import written

# A block has at least this many rows, and of a large table as many as hold this many numbers.
BLOCK_ROWS = 2000
BLOCK_VALUES = 1 << 20
# Distances that a task holds at once.
PAIRS = 1 << 20
# Shares of the summed squares of two rows below which their squared distance is taken from the differences.
CLOSE = 1e-4
MOST_TASKS = 4096


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: mse, mae, r2. The total sum of squares comes from the variance, so one pass is enough."""
    error = F.col(y) - F.col(p)
    return df.agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("__v")
    ).select("mse", "mae", (1 - F.try_divide("mse", "__v")).alias("r2"))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str, p: str, wide: bool = False) -> DataFrame:
    """(actual, predicted, n), or one row per actual label with a column per predicted one."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("actual").pivot("predicted").agg(F.first("n")).fillna(0) if wide else counts


def _distances(a: np.ndarray, z: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, Euclidean distances of some rows of ``a`` to those of ``z``); both lie around the origin.

    A matrix product gives the squares. Those it leaves without enough digits, as of rows that
    hardly differ, and those that are no number, are taken from the differences instead.
    """
    na, nz = (a * a).sum(axis=1), (z * z).sum(axis=1)
    left, right = np.column_stack([a, na, np.ones(len(a))]), np.column_stack([-2 * z, np.ones(len(z)), nz]).T
    step = max(1, PAIRS // len(z))
    for i in range(0, len(a), step):
        found, at = left[i : i + step] @ right, na[i : i + step]
        doubtful = np.flatnonzero(~(found.min(axis=1) > CLOSE * (at + nz.max())))
        if len(doubtful):
            rows, columns = np.nonzero(~(found[doubtful] > CLOSE * (at[doubtful, None] + nz)))
            rows = doubtful[rows]
            some = max(1, PAIRS // max(1, a.shape[1]))
            for k in range(0, len(rows), some):
                r, c = rows[k : k + some], columns[k : k + some]
                found[r, c] = ((a[i + r] - z[c]) ** 2).sum(axis=1)
        yield i, np.sqrt(found, out=found)


def _cluster_sums(a: pd.DataFrame, z: pd.DataFrame, same: bool) -> pd.DataFrame:
    """(id, c, other_c, total): summed distances of the rows of two blocks to the other one's clusters.

    ``same`` says that they are one block, whose rows must be told once.
    """
    a, z = a.sort_values("c", na_position="last"), z.sort_values("c", na_position="last")
    xa, xz = np.vstack(a["x"].to_numpy()).astype(float), np.vstack(z["x"].to_numpy()).astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        plain = xa[np.isfinite(xa).all(axis=1)]
        middle = plain.mean(axis=0) if len(plain) else np.zeros(xa.shape[1])
        xa, xz = xa - middle, xz - middle
        # rows without a cluster are last: they belong to no cluster's sum
        (ca, ia), (cz, iz) = (np.unique(side["c"].dropna().to_numpy(), return_index=True) for side in (a, z))
        known = z["c"].notna().sum()
        to_z, to_a = np.zeros((len(xa), len(cz))), np.zeros((len(ca), len(xz)))
        bounds = [*ia, a["c"].notna().sum()]
        for i, found in _distances(xa, xz):
            if known:
                to_z[i : i + len(found)] = np.add.reduceat(found[:, :known], iz, axis=1)
            for k in range(0 if same else len(ca)):
                low, high = max(bounds[k] - i, 0), min(bounds[k + 1] - i, len(found))
                if low < high:
                    to_a[k] += found[low:high].sum(axis=0)
    told = [(a, cz, to_z)] if same else [(a, cz, to_z), (z, ca, to_a.T)]
    return pd.concat([
        pd.DataFrame({
            "id": np.repeat(side["id"].to_numpy(), len(others)), "c": np.repeat(side["c"].to_numpy(), len(others)),
            "other_c": np.tile(others, len(side)), "total": totals.ravel()})
        for side, others, totals in told])


def silhouette(df: DataFrame, key: str, features: str, cluster: str, block_rows: int | None = None) -> DataFrame:
    """(cluster, n, silhouette): mean Euclidean silhouette per cluster.

    The measure compares every row with every other by definition, so its time grows with the square of the
    rows. Rows are hashed into blocks; each unordered pair of blocks is worked out by one task as matrix products
    of some ``PAIRS`` numbers, of which only the sums per row and cluster, of both blocks, leave the task. Blocks have
    about ``block_rows`` rows, or as many as keep all cores busy and ``BLOCK_VALUES`` numbers in a block. Beyond
    that use :func:`squared_silhouettes`, which is linear.
    """
    rows = df.select(F.col(key).alias("id"), F.col(features).alias("x"), F.col(cluster).alias("c"))
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if block_rows is None:
        busy = math.ceil(math.sqrt(6 * df.sparkSession.sparkContext.defaultParallelism))
        block_rows = min(max(BLOCK_ROWS, -(-n // busy)), max(BLOCK_ROWS, BLOCK_VALUES // max(1, width or 0)))
    blocks = max(1, -(-n // block_rows))
    placed = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # a task for each pair, so that no one of them waits behind others
    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    left = placed.withColumn("other", F.explode(F.sequence("b", F.lit(blocks - 1)))).repartition(tasks, "b", "other")
    right = placed.withColumnRenamed("b", "other").withColumn("b", F.explode(F.sequence(F.lit(0), "other"))).repartition(tasks, "b", "other")

    def sums_of(pair: tuple, a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if a.empty or z.empty:
            return pd.DataFrame({"id": [], "c": [], "other_c": [], "total": []}).astype(
                {"id": "int64", "c": "int32", "other_c": "int32", "total": "float64"})
        return _cluster_sums(a, z, bool(pair[0] == pair[1]))

    sums = (
        left.groupBy("b", "other").cogroup(right.groupBy("b", "other"))
        .applyInPandas(sums_of, "id bigint, c int, other_c int, total double")
        .groupBy("id", "c", "other_c").agg(F.sum("total").alias("total"))
    )
    own = F.col("c") == F.col("other_c")
    means = sums.join(sizes.withColumnRenamed("c", "other_c"), "other_c").groupBy("id", "c").agg(
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.max(F.when(own, F.col("size"))).alias("own_size"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    value = F.when((F.col("own_size") == 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return means.select(F.col("c").alias(cluster), value.alias("s")).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))


def squared_silhouette(df: DataFrame, features: str, cluster: str) -> float:
    """Silhouette of squared Euclidean distances, in linear time."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(df)


def squared_silhouettes(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """(cluster, n, silhouette): mean silhouette of squared Euclidean distances per cluster, in linear time.

    A row's squared distances to a whole cluster follow from the cluster's size, vector sum
    and sum of squares. That table, one vector per cluster, must fit a broadcast. Rows without
    a cluster or features are left out.
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    rows = df.select(F.col(cluster).alias("c"), F.col(features).cast("array<double>").alias("x")).dropna()
    rows = rows.withColumn("q", dot(F.col("x"), F.col("x")))
    sums = rows.select("c", F.posexplode("x").alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("s"))
    clusters = written(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q")).join(vectors, "c"), "clusters")
    if not fits_broadcast(clusters):
        raise ValueError("the vectors of all clusters do not fit a broadcast")
    known = clusters.toPandas()
    place = {c: i for i, c in enumerate(known["c"])}
    n, q, s = known["n"].to_numpy(dtype=float), known["q"].to_numpy(), np.array(known["s"].tolist())

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            at, each = batch["c"].map(place).to_numpy(), np.arange(len(batch))
            total = np.maximum(0.0, n * batch["q"].to_numpy()[:, None] - 2 * np.vstack(batch["x"]) @ s.T + q)
            a = total[each, at] / np.maximum(1, n[at] - 1)
            mean = total / n
            mean[each, at] = np.inf
            b = mean.min(axis=1)
            most = np.maximum(a, b)
            single = (n[at] == 1) | np.isinf(b) | (most == 0)
            yield pd.DataFrame({"c": batch["c"], "v": np.where(single, 0.0, (b - a) / np.where(single, 1.0, most))})

    told = rows.mapInPandas(values, T.StructType([rows.schema["c"], T.StructField("v", T.DoubleType())]))
    return told.groupBy(F.col("c").alias(cluster)).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("silhouette"))


def compare(baseline: DataFrame, improved: DataFrame) -> DataFrame:
    """(metric, baseline, improved, delta) of two one-row metric tables with the same columns."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).cast("double").alias(c) for c in baseline.columns]).unpivot(
            [], baseline.columns, "metric", name)

    both = long(baseline, "baseline").join(long(improved, "improved"), "metric")
    return both.withColumn("delta", F.col("improved") - F.col("baseline"))
