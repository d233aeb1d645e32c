"""Top-k, full ranks and exact-size selection without one big sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 65_536


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    Catalyst turns ``row_number() <= k`` into a group limit before the shuffle,
    so a task receives at most k rows per group and upstream task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def full_rank(df: DataFrame, group: str, score: str, doc: str, rank: str = "rank") -> DataFrame:
    """Rank every row by score descending, then id, for groups of any size.

    Rows are cut into blocks (group, score, id range). Block sizes are summed
    over the small block table, and each row adds its place inside its block.
    Suits scores with few distinct values, such as term coverage.
    """
    blocks = df.withColumn("__block", F.floor(F.col(doc) / F.lit(BLOCK)))
    sizes = blocks.groupBy(group, score, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(F.desc(score), "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, score, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, score, "__block").orderBy(doc)
    placed = blocks.withColumn("__place", F.row_number().over(inside))
    return (
        placed.join(offsets, [group, score, "__block"])
        .withColumn(rank, (F.col("__before") + F.col("__place")).cast("int"))
        .drop("__block", "__before", "__place")
    )


def mark_first(df: DataFrame, n: Column, order_hash: Column, tie: list[str], flag: str, bits: int = 16) -> DataFrame:
    """Add ``flag``: true for the ``n`` rows with the smallest hash, exactly.

    ``n`` is an expression over ``__total``, the row count. Rows fall into
    2**bits hash buckets; whole buckets below the cut are taken, buckets above it
    are not, and only the one bucket on the cut is sorted.
    """
    hashed = df.withColumn("__h", order_hash).withColumn("__b", F.shiftrightunsigned("__h", 64 - bits))
    sizes = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    running = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = (
        sizes.withColumn("__upto", F.sum("__n").over(running))
        .withColumn("__total", F.sum("__n").over(whole))
        .withColumn("__take", n.cast("long") - (F.col("__upto") - F.col("__n")))
        .select(F.col("__b"), F.when(F.col("__take") > 0, F.least("__take", "__n")).otherwise(F.lit(0)).alias("__take"),
                F.col("__n").alias("__size"))
    )
    # one row per bucket: at most 2**bits rows
    placed = hashed.join(F.broadcast(cut), "__b")
    on_cut = (F.col("__take") > 0) & (F.col("__take") < F.col("__size"))
    ranked = placed.filter(on_cut).withColumn(
        flag, F.row_number().over(Window.partitionBy("__b").orderBy("__h", *tie)) <= F.col("__take")
    )
    settled = placed.filter(~on_cut).withColumn(flag, F.col("__take") == F.col("__size"))
    return settled.unionByName(ranked).drop("__h", "__b", "__take", "__size")


def group_places(df: DataFrame, group: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """Add ``place``: 1, 2, ... in the order of each group, for groups of any size.

    Rows are dealt by ranges of (group, order). A range numbers its own rows of a group, and the
    counts of earlier ranges, a small table, are added. The ranged rows are written, so that a
    lost task is not dealt anew.
    """
    from corpuslab.plans.storage import written

    ranged = df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__range").orderBy(*order)
    numbered = ranged.withColumn("__place", F.row_number().over(inside))
    # one row per group and range; a group of many ranges has as many keys
    return numbered.join(starts, [*group, "__range"]).withColumn(place, F.col("__start") + F.col("__place")).drop("__range", "__start", "__place")
