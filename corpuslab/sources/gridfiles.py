"""Grid files: first line ``rows,cols``, then one line per row with cells joined by single spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def write_grid(cells: DataFrame, n_rows: int, n_cols: int, path: str) -> None:
    """Write one sheet from (row_idx, col_idx, value); absent cells are empty.

    Spaces, percent signs and line breaks inside a value are percent-escaped, so
    that splitting on single spaces gives the cells back. A line is built from one
    row's cells, and lines are written in row order.
    """
    spark = cells.sparkSession
    safe = F.col("value")
    for raw, code in (("%", "%25"), (" ", "%20"), ("\n", "%0A"), ("\r", "%0D")):
        safe = F.replace(safe, F.lit(raw), F.lit(code))
    by_row = cells.groupBy("row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", safe.alias("v")))).alias("found")
    )
    line = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)),
                    lambda c: F.coalesce(F.try_element_at("found", c), F.lit(""))), " ")
    rows = spark.range(n_rows).select(F.col("id").alias("row_idx")).join(by_row, "row_idx", "left").select(
        F.col("row_idx").alias("at"), F.coalesce(line, F.lit(" " * (n_cols - 1))).alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("at"), F.lit(f"{n_rows},{n_cols}").alias("value"))
    head.unionByName(rows).sort("at").select("value").write.mode("overwrite").text(path)


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(cells, n_rows, n_cols). Cells are (row_idx, col_idx, value) without empty values.

    Part files are read in name order and lines numbered within each part, then
    shifted by the lines of the parts before it.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"))
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per file block
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    numbered = lines.join(starts, ["file", "block"]).select(
        (F.col("before") + F.col("seq") - F.col("first") - 1).alias("row_idx"), "value")
    n_rows, n_cols = map(int, numbered.filter("row_idx = -1").first()["value"].split(","))
    cells = numbered.filter("row_idx >= 0").select(
        "row_idx", F.posexplode(F.split("value", " ")).alias("col_idx", "value")).filter("value <> ''")
    text = F.col("value")
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("%", "%25")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return cells.withColumn("value", text), n_rows, n_cols
