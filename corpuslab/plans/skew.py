"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Keys with more rows than one task should hold are all hot; there are at most rows / ROWS_PER_SALT
# of them. Of the others, the heaviest are.
ROWS_PER_SALT = 1_000_000
HOT_KEYS = 1024
# A hot key is spread over this many tasks, or over more when it has more rows than they should hold.
SALTS = 64
# A key with fewer rows than this is no burden to one task and is not salted.
HOT_MIN_ROWS = 100_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure rows and bytes of ``df`` by one aggregation.

    A limit would send that many rows of every partition to one task; counts are
    combined where the rows are.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    widths = [
        F.lit(8) if isinstance(f.dataType, T.NumericType)
        else F.coalesce(F.length(F.col(f.name) if isinstance(f.dataType, T.StringType) else F.to_json(F.struct(f.name))), F.lit(0)) + 16
        for f in df.schema.fields
    ]
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(reduce(lambda a, b: a + b, widths)).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def hot_keys(
    counts: DataFrame, keys: list[str], count_col: str, min_rows: int | None = None, rows_per_salt: int | None = None
) -> DataFrame:
    """The keys to spread, and the number of salts of each, ``__salts``.

    All keys with at least ``rows_per_salt`` rows, and the ``HOT_KEYS`` heaviest of those with at least
    ``min_rows``. A key gets ``SALTS`` salts, or as many as keep ``rows_per_salt`` rows in a task.
    """
    least = HOT_MIN_ROWS if min_rows is None else min_rows
    per_salt = ROWS_PER_SALT if rows_per_salt is None else rows_per_salt
    n = F.col(count_col)
    salts = F.greatest(F.lit(SALTS), F.ceil(n / F.lit(per_salt))).cast("int")
    chosen = counts.filter(n >= least).select(*keys, n.alias("__n"), salts.alias("__salts"))
    lighter = chosen.filter(F.col("__n") < per_salt).orderBy(F.desc("__n"), *keys).limit(HOT_KEYS)
    return chosen.filter(F.col("__n") >= per_salt).unionByName(lighter).select(*keys, "__salts")


def heaviest(counts: DataFrame, keys: list[str], count_col: str, min_rows: int | None = None) -> DataFrame:
    """The keys that :func:`hot_keys` chooses."""
    return hot_keys(counts, keys, count_col, min_rows).select(*keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot: DataFrame,
    salt_by: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join with the hot keys of ``left``, spread over as many tasks as :func:`hot_keys` says, or ``SALTS``.

    Only rows of ``right`` with a hot key are copied, once per salt; every other
    key joins on salt 0. ``salt_by`` names left columns that vary within a key.
    """
    salts = F.col("__salts") if "__salts" in hot.columns else F.lit(SALTS)
    marked = F.broadcast(hot.select(*keys, salts.alias("__salts")))
    is_hot = F.col("__salts").isNotNull()
    spread = left.join(marked, keys, "left").withColumn(
        "__salt",
        F.when(is_hot, F.pmod(F.xxhash64(*salt_by), F.col("__salts")).cast("int")).otherwise(F.lit(0)),
    )
    copied = right.join(marked, keys, "left").withColumn(
        "__salt",
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.col("__salts") - 1)).otherwise(F.array(F.lit(0)))),
    )
    return spread.drop("__salts").join(copied.drop("__salts"), [*keys, "__salt"], how).drop("__salt")


def join_small_or_salted(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    salt_by: list[str],
    how: str = "inner",
    max_rows: int | None = None,
) -> DataFrame:
    """Broadcast ``right`` when it is measured to be small, else a salted shuffle join."""
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return salted_join(left, right, keys, hot_keys(counts, keys, "__n"), salt_by, how)


def attach_stats(
    rows: DataFrame, keys: list[str], salt_by: list[str], **aggregates: Column
) -> DataFrame:
    """Per-key aggregates joined back onto the rows.

    A window would pull each key's rows into one task. Here the aggregate is
    computed with map-side combining and joined back with hot keys spread out.
    """
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in aggregates.items()])
    hot = hot_keys(stats, keys, "__n")
    return salted_join(rows, stats.drop("__n"), keys, hot, salt_by)
