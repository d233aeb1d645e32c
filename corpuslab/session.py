"""Spark session settings used by the tests, the bench and the tools."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "corpuslab", cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """A single-JVM session. On a cluster, pass the cluster's own session to the operators."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
