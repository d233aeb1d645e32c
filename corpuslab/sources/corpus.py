"""Scans: document tables, link tables, page-view logs, CSV frames, query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ARTICLES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("anchor_text", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]))),
])


def read_corpus(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None, exclude: tuple[str, ...] = ()
) -> DataFrame:
    """Parquet scan of one or many paths, leaving out files whose names start with ``exclude``.

    The name filter is on file metadata, so excluded files are never opened.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    for prefix in exclude:
        df = df.filter(~F.col("_metadata.file_name").startswith(prefix))
    return df


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores when the scan has fewer splits than cores.

    A table of many splits, the normal case on a cluster, is left as it is, also when it is one
    large file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_links(spark: SparkSession, glob: str) -> DataFrame:
    """Two-column scan of all articles that match a glob, for the link graph."""
    return spark.read.schema(ARTICLES).parquet(glob).select("id", "anchor_text")


def read_pageviews(spark: SparkSession, path: str, prefix: str = "en.wikipedia") -> DataFrame:
    """(id, views) from a space-separated monthly dump, plain or bz2.

    Keeps lines of one project whose third and fifth fields are numbers.
    """
    fields = F.split(F.col("value"), " ")
    picked = (
        spark.read.text(path)
        .filter(F.col("value").startswith(prefix + " "))
        .select(F.get(fields, F.lit(2)).alias("id"), F.get(fields, F.lit(4)).alias("views"))
        .filter(F.col("id").rlike(r"^[0-9]+$") & F.col("views").rlike(r"^[0-9]+$"))
    )
    return picked.select(F.col("id").cast("long"), F.col("views").cast("long"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header. ``multi_line=True`` lets quoted values span lines, which keeps a
    file in one task; without it large files are split."""
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line).csv(path)


def write_predictions(df: DataFrame, path: str, id_col: str = "video_id", prediction: str = "prediction") -> None:
    df.select(id_col, prediction).write.mode("overwrite").option("header", True).csv(path)


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id) pairs from a JSON object ``{query: [relevant ids]}``."""
    parsed = F.from_json(F.col("value"), T.MapType(T.StringType(), T.ArrayType(T.LongType())))
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(parsed).alias("query", "ids"))
        .select("query", F.explode("ids").alias("doc_id"))
    )


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) for each non-blank line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")
