"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuslab.plans.skew import fits_broadcast
from corpuslab.plans.storage import written

# Text handled at once inside a task. A single longer text is handled alone.
SLICE_BYTES = 4 << 20
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, label: str = "numbered") -> tuple[DataFrame, str]:
    """Write ``df`` with a row number and return the written table and the number's name.

    Equal rows get different numbers. The numbers are read from files afterwards, so
    a stage that is run again sees the same ones.
    """
    row = free_name(df, "row_number_")
    return written(df.withColumn(row, F.monotonically_increasing_id()), label), row


# Rows of one file that a row key can tell apart.
ROWS_PER_FILE = 1 << 36


def row_keys(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number that is different in each row and the same in every run, and its name.

    Rows of a scan are named by their file and place in it, so that nothing is copied; other
    tables are written with numbers.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window

    row, path = free_name(df, "row_number_"), free_name(df, "file_path_")
    try:
        named = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return numbered(df)
    # one row per file
    files = named.select(path).distinct().withColumn("file_number_", F.row_number().over(Window.orderBy(path)))
    files = written(files, "files")
    columns = [F.col(quoted(c)) for c in df.columns]
    keyed = named.join(F.broadcast(files), path)
    return keyed.select(*columns, (F.col("file_number_") * F.lit(ROWS_PER_FILE) + F.col(quoted(row))).alias(row)), row


# Pairs of a row number and a small number are broadcast up to so many.
FEW_ROWS = 2_000_000


def without(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """``rows`` but for those in ``dropped``, which is broadcast where it is measured to be small, so that texts stay in place."""
    return rows.join(F.broadcast(dropped) if fits_broadcast(dropped, FEW_ROWS) else dropped, row, "left_anti")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``SLICE_BYTES`` of text each."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory of a worker process to the system, so that idle workers stay small."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def map_text(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str | None]], list[list]]],
    keep: list[str] | None = None,
    tidy: bool = False,
) -> DataFrame:
    """Add columns computed from whole texts, a slice of rows at a time.

    ``make()`` runs once per task and returns the function from a list of texts to
    one list per new column. All columns are kept unless ``keep`` names fewer; an
    input column with the name of a new one is replaced by it. With ``tidy`` a task returns
    freed memory at its end, for stages that follow others on the same executors.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    columns = [F.col(quoted(c)) for c in keep]
    given = text
    if text not in keep or not isinstance(df.schema[text].dataType, T.StringType):
        given = free_name(df, "text_given_")
        columns.append(F.col(quoted(text)).cast("string").alias(given))
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, given):
                made = work(part.column(given).to_pylist())
                arrays = [part.column(c) for c in keep] + [pa.array(v, t) for v, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        if tidy:
            give_back()

    return df.select(*columns).mapInArrow(run, schema)


def bucket_rank(
    rows: DataFrame, group: list[str], bucket: Column, order: list[Column], amount: Column, before: str
) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over earlier rows of the group.

    ``bucket`` cuts a group into pieces in the same direction as ``order``. Sums of
    pieces are added up over the small table of pieces, and rows are sorted within
    one piece only, so that no group meets in one task.
    """
    from pyspark.sql import Window

    piece, size, start = (free_name(rows, c) for c in ("piece_", "piece_sum_", "piece_start_"))
    cut = rows.withColumn(piece, bucket)
    sums = cut.groupBy(*group, piece).agg(F.sum(amount).alias(size))
    earlier = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn(start, F.coalesce(F.sum(size).over(earlier), F.lit(0))).drop(size)
    inside = Window.partitionBy(*group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn(before, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    keys = [*group, piece]
    joined = placed.join(starts, keys)
    return joined.withColumn(before, F.col(before) + F.col(start)).drop(piece, start)
