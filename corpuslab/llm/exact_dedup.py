"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after each run of white space becomes one space.
Misra-Gries summaries, one per task and then added up, find every digest that may
hold more than 1/256 of the rows. Those are counted exactly with map-side sums and
their winners broadcast, so the rows of a frequent text never meet in one task; all
other digests go through an ordinary shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpuslab.llm.common import SPACE, quoted, row_keys, without
from corpuslab.plans.storage import scratch, written

# A digest is frequent when it holds at least 1/HOT of all rows.
HOT = 256
# Counters of one summary. Counts are too low by at most rows / (COUNTERS + 1).
COUNTERS = 1023


def digest(text: Column) -> Column:
    """SHA-256 of the text with white space normalised; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def misra_gries(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(value, at_least): lower bounds of counts, from one summary per task added up.

    The bounds are too low by at most rows / (counters + 1), so every value with more
    rows than that is listed.
    """

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counts[value] = counts.get(value, 0) + n
            if len(counts) > counters:
                each = np.fromiter(counts.values(), np.int64, len(counts))
                cut = int(np.partition(each, -counters - 1)[-counters - 1])
                counts = {v: n - cut for v, n in counts.items() if n > cut}
        yield pa.RecordBatch.from_pydict({
            "value": pa.array(list(counts), pa.string()), "at_least": pa.array(list(counts.values()), pa.int64())})

    each = df.select(F.col(quoted(column)).alias("value")).mapInArrow(run, "value string, at_least long")
    return each.groupBy("value").agg(F.sum("at_least").alias("at_least"))


def frequent(rows: DataFrame, column: str, n_rows: int) -> DataFrame:
    """Candidates for frequent values, at most 341 of them.

    A value with at least 1/HOT of the rows has a bound of at least
    n/HOT - n/(COUNTERS+1) = 3n/1024, and bounds add up to at most n.
    """
    least = n_rows / HOT - n_rows / (COUNTERS + 1)
    return misra_gries(rows, column).filter((F.col("at_least") >= least) & (F.col("at_least") > 0)).select("value")


def groups(docs: DataFrame, row: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: (row, id, text_sha256, keep_id, group_size, kept).

    ``row`` names a column with a different stable number in each row. Of equal texts the
    smallest id stays; null ids come last, equal ids are told apart by ``row``. A null text
    is an empty text. An empty table gives an empty result.
    """
    rows = written(
        docs.select(F.col(quoted(row)).alias("row"), F.col(quoted(id_col)).alias("id"),
                    digest(F.col(quoted(text))).alias("text_sha256")), "digests")
    n_rows = rows.count()
    hot = written(frequent(rows, "text_sha256", n_rows).withColumnRenamed("value", "text_sha256"), "frequent")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    size = F.count(F.lit(1)).alias("group_size")
    # at most 341 rows, see frequent()
    winners = written(
        rows.join(F.broadcast(hot), "text_sha256", "left_semi").groupBy("text_sha256").agg(size, first)
        .filter(F.col("group_size") >= n_rows / HOT), "winners")
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    rest = marked.filter("group_size IS NULL").drop("group_size", "first")
    settled = rest.join(rest.groupBy("text_sha256").agg(size, first), "text_sha256")
    return marked.filter("group_size IS NOT NULL").unionByName(settled).select(
        "row", "id", "text_sha256", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"))


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, row = row_keys(docs)
    with scratch(docs.sparkSession) as scope:
        dropped = groups(rows, row, text, id_col).filter(~F.col("kept")).select(F.col("row").alias(row))
        dropped = scope.result(dropped, "dropped")
    return without(rows, dropped, row).drop(row)


def op10_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = groups(docs.withColumn("row", F.monotonically_increasing_id()), "row")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
