"""Cutting lineage and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslab-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of it.

    The result has no lineage, survives lost executors, and later reads prune
    columns and row groups, which an RDD checkpoint cannot do.
    """
    path = new_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Paths of the tables written in each open scope, the innermost last.
_scopes: list[list[str]] = []


class Scope:
    """What :func:`scratch` gives: writes the tables that outlive it."""

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """As :func:`written`, but the table stays when the scope ends."""
        inner = _scopes.pop()
        try:
            return written(df, label)
        finally:
            _scopes.append(inner)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scope]:
    """Remove the tables that are written inside, but for results, when the block ends.

    Results are written tables themselves, so nothing that is read later needs what is removed.
    """
    _scopes.append([])
    try:
        yield Scope()
    finally:
        paths = _scopes.pop()
        jvm = spark._jvm
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        # shuffle files go when nothing refers to their plans any more
        gc.collect()
        jvm.System.gc()
