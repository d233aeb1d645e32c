"""Structured Streaming: live occupancy and live cell values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from corpuslab.plans.storage import new_path


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Stream the parquet files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def occupancy(events: DataFrame, key: str, delta: str, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(key, start, end, change, moves): arrivals minus departures per window.

    Works on a stream and on a table. On a stream a window is final once the
    watermark passes its end, and later events are dropped.
    """
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), key)
        .agg(F.sum(delta).alias("change"), F.count(F.lit(1)).alias("moves"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "change", "moves")
    )


def running_level(changes: DataFrame, key: str) -> DataFrame:
    """Level after each window: changes added up per key. A key has one row per window."""
    upto = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("level", F.sum("change").over(upto))


def latest_cells(edits: DataFrame) -> DataFrame:
    """(sheet_id, row_idx, col_idx, value, seq): the edit with the highest seq of each cell."""
    return (
        edits.groupBy("sheet_id", "row_idx", "col_idx")
        .agg(F.max(F.struct("seq", "value")).alias("last"))
        .select("sheet_id", "row_idx", "col_idx", "last.value", "last.seq")
    )


def drain(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over all data at hand and return what it put out, with its batch number.

    A batch overwrites its own folder, so a batch that runs twice after a failure
    leaves one result. Progress and state live in the shared folder.
    """
    spark = stream.sparkSession
    out = new_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{out}/progress").foreachBatch(keep).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{out}/data")


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key from the output of an update-mode stream."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*values), "batch").alias("v")
    return updates.groupBy(*keys).agg(last).select(*keys, "v.*")
