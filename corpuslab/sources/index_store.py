"""Index on disk: postings sorted by term, term table, lengths, one-row statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuslab.functions.text import bucket_of
from corpuslab.operators.index import Index

BUCKETS = 124
ROWS_PER_FILE = 4_000_000

STATS = "n_docs bigint, avgdl double, buckets int, min_postings int"
POSTINGS = "term string, doc_id bigint, tf int, dl int, bucket int"


def write_index(index: Index, path: str, buckets: int = BUCKETS) -> None:
    """Write all parts of an index.

    Postings are shuffled by (bucket, piece) and sorted by term: a lookup skips buckets
    and row groups, and a bucket has a piece for every ``ROWS_PER_FILE`` of its postings, so
    that a term with very many is split over several tasks and files.
    """
    bucket = bucket_of(F.col("term"), buckets).alias("bucket")
    kept = index.kept_postings().select("term", "doc_id", "tf", "dl", bucket)
    sizes = index.terms.groupBy(bucket).agg(F.ceil(F.sum("df") / F.lit(ROWS_PER_FILE)).alias("pieces")).collect()  # one row per folder
    pieces = F.element_at(F.array(*[F.lit(n) for n in _pieces(sizes, buckets)]), F.col("bucket") + 1)
    tasks = max(sum(r["pieces"] for r in sizes), int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (
        kept.repartition(tasks, "bucket", F.pmod(F.xxhash64("doc_id"), pieces))
        .sortWithinPartitions("bucket", "term", "doc_id")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    )
    index.terms.sort("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.doc_lengths.sort("id").write.mode("overwrite").parquet(f"{path}/doc_lengths")
    write_stats(index, f"{path}/stats", buckets)


def _pieces(sizes: list[T.Row], buckets: int) -> list[int]:
    """The pieces of each bucket, 1 for an empty one."""
    found = {r["bucket"]: int(r["pieces"]) for r in sizes}
    return [found.get(b, 1) for b in range(buckets)]


def write_stats(index: Index, path: str, buckets: int = BUCKETS) -> None:
    spark = index.terms.sparkSession
    row = index.n_docs, index.avgdl, buckets, index.min_postings
    spark.createDataFrame([row], STATS).write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, path: str) -> T.Row:
    return spark.read.schema(STATS).parquet(path).first()


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """Postings of some terms, or of all. Few terms touch only their bucket folders and row groups."""
    df = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    if terms is not None:
        buckets = read_stats(spark, f"{path}/stats")["buckets"]
        wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), buckets))
        df = df.filter(F.col("bucket").isin([r[0] for r in wanted.collect()]) & F.col("term").isin(terms))
    return df.select("term", "doc_id", "tf", "dl", "bucket")


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None) -> Index:
    table = spark.read.schema("term string, df bigint, term_total bigint").parquet(f"{path}/terms")
    stats = read_stats(spark, f"{path}/stats")
    return Index(
        read_postings(spark, path, terms),
        table if terms is None else table.filter(F.col("term").isin(terms)),
        spark.read.schema("id bigint, dl int").parquet(f"{path}/doc_lengths"),
        stats["n_docs"], stats["avgdl"], stats["buckets"], stats["min_postings"],
    )
