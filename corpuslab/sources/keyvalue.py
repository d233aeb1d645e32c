"""Key-sorted side tables as text or parquet, and a check that files are in key order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def write_kv(df: DataFrame, path: str, key: str = "id", fmt: str = "parquet") -> None:
    """Write a two-column table sorted by key; parts are in global key order."""
    value = next(c for c in df.columns if c != key)
    ordered = df.select(key, value).sort(key, value)
    if fmt == "text":
        ordered.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"))).write.mode(
            "overwrite"
        ).text(path)
    else:
        ordered.write.mode("overwrite").format(fmt).save(path)


def read_kv(spark: SparkSession, path: str, value: str, value_type: str, key: str = "id") -> DataFrame:
    """Read the text form back: the first tab ends the key."""
    at = F.instr("value", "\t")
    return spark.read.text(path).select(
        F.expr("left(value, instr(value, '\t') - 1)").cast("long").alias(key),
        F.expr("substring(value, instr(value, '\t') + 1)").cast(value_type).alias(value),
    ).filter(at > 0)


def sortedness(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """One row per parquet part: rows, first and last key, and how many steps go down.

    ``breaks`` counts descents inside the part, plus one when its first key is
    below the last key of the part before it. Rows are compared where they are read;
    only a summary of each batch is shuffled.
    """
    placed = spark.read.parquet(path).select(
        F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"))
    kind = placed.schema["key"].dataType.simpleString()

    def runs(batches):
        for batch in batches:
            keys, files, pos = batch.columns
            names = files.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    k = keys.slice(a, z - a)
                    falls = pc.sum(pc.greater(k.slice(0, len(k) - 1), k.slice(1))).as_py() or 0
                    yield pa.RecordBatch.from_arrays(
                        [files.slice(a, 1), pos.slice(a, 1), pa.array([z - a], pa.int64()), k.slice(0, 1), k.slice(len(k) - 1, 1),
                         pa.array([falls], pa.int64())], names=["file", "pos", "n", "first", "last", "falls"])

    found = placed.mapInArrow(runs, f"file string, pos bigint, n bigint, first {kind}, last {kind}, falls bigint")
    step = Window.partitionBy("file").orderBy("pos")
    parts = (
        found.withColumn("falls", F.col("falls") + F.when(F.lag("last").over(step) > F.col("first"), 1).otherwise(0))
        .groupBy("file")
        .agg(F.sum("n").alias("n_rows"), F.min_by("first", "pos").alias("first_key"),
             F.max_by("last", "pos").alias("last_key"), F.sum("falls").alias("inner_breaks"))
    )
    chain = Window.orderBy("file")  # one row per part file
    between = F.when(F.lag("last_key").over(chain) > F.col("first_key"), 1).otherwise(0)
    return parts.select(
        F.row_number().over(chain).alias("part"), "n_rows", "first_key", "last_key",
        (F.col("inner_breaks") + between).alias("breaks"),
    )
