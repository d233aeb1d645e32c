"""Exact quantiles with linear interpolation on columns of any size.

Spark's exact ``percentile`` keeps a map of all distinct values in one buffer. Here mergeable
quantile sketches cut a column into cells, one count per cell tells which cells the wanted
ranks lie in, and only the distinct values of those cells are sorted. A cell of too many
rows is cut again by sketches of its own rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

INTERVAL_ROWS = 1_000_000
ACCURACY = 10_000
# Cuts of a column, or of a cell that is cut again.
CUTS = 256


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], interval_rows: int | None = None
) -> dict[str, list[float | None]]:
    """Quantiles per column, NULLs and NaNs ignored; None for a column without values.

    Cells of up to ``interval_rows`` rows are sorted, each by itself.
    """
    limit = INTERVAL_ROWS if interval_rows is None else interval_rows
    columns = list(wanted)
    data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    row = data.agg(*[F.count(f"v{i}").alias(str(i)) for i in range(len(columns))]).first()
    n = [row[str(i)] for i in range(len(columns))]
    ranks = [sorted({k for p in wanted[c] if n[i] for k in (math.floor((n[i] - 1) * p), math.ceil((n[i] - 1) * p))}) for i, c in enumerate(columns)]
    values = _at_ranks(data, n, ranks, limit)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for p in wanted[c]:
            if not n[i]:
                out[c].append(None)
                continue
            h = (n[i] - 1) * p
            a, b = values[i, math.floor(h)], values[i, math.ceil(h)]
            out[c].append(a + (h - math.floor(h)) * (b - a))
    return out


def _cell(data: DataFrame, i: int, splits: list[float]) -> DataFrame:
    """Add ``cell<i>``: the place of v<i> among the ascending ``splits``, found by binary search; -1 for NULL."""
    if not splits:
        return data.withColumn(f"cell{i}", F.when(F.col(f"v{i}").isNull(), -1).otherwise(0))
    inner = [float("-inf"), *splits, float("inf")]
    found = Bucketizer(splits=inner, inputCol=f"v{i}", outputCol="__cell", handleInvalid="keep").transform(data)
    return found.withColumn(f"cell{i}", F.when(F.col(f"v{i}").isNull(), -1).otherwise(F.col("__cell").cast("int"))).drop("__cell")


def _entries(data: DataFrame, splits: list[list[float]]) -> DataFrame:
    """(c, cell, v): one row per value of every column."""
    for i, own in enumerate(splits):
        data = _cell(data, i, own)
    parts = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"cell{i}").alias("cell"), F.col(f"v{i}").alias("v")) for i in range(len(splits))])
    return data.select(F.explode(parts).alias("e")).select("e.*").filter("v IS NOT NULL")


def _at_ranks(data: DataFrame, n: list[int], ranks: list[list[int]], limit: int) -> dict[tuple[int, int], float]:
    """The values of the wanted ranks of each column."""
    shares = [i / CUTS for i in range(1, CUTS)]
    splits: list[list[float]] = [[] for _ in n]
    sketch = {i: F.percentile_approx(f"v{i}", shares, ACCURACY) for i in range(len(n)) if n[i] > limit and ranks[i]}
    while True:
        if sketch:
            row = data.agg(*[c.alias(f"q{j}") for j, c in enumerate(sketch.values())]).first()
            for j, key in enumerate(sketch):
                i = key if isinstance(key, int) else key[0]
                # every cut value is a cell of its own, so that a value of many rows needs no search
                cuts = {x for v in row[f"q{j}"] for x in (v, math.nextafter(v, math.inf))}
                splits[i] = sorted({*splits[i], *(x for x in cuts if math.isfinite(x))})
        entries = _entries(data, splits)
        cells: list[dict[int, tuple[int, float, float]]] = [{} for _ in n]
        if any(splits):
            for r in entries.groupBy("c", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).collect():
                cells[r["c"]][r["cell"]] = r["n"], r["a"], r["z"]  # as many rows as cells
        found: dict[tuple[int, int], float] = {}
        below: list[dict[int, int]] = [{} for _ in n]
        sketch = {}
        for i, own in enumerate(splits):
            if not own:
                below[i] = {0: 0} if ranks[i] else {}
                continue
            order, before = sorted(cells[i]), [0]
            for cell in order:
                before.append(before[-1] + cells[i][cell][0])
            for k in ranks[i]:
                at = bisect_right(before, k) - 1
                cell = order[at]
                rows, a, z = cells[i][cell]
                if a == z:
                    found[i, k] = a
                    continue
                below[i][cell] = before[at]
                if rows > limit:
                    # the least value is a cut, so the cell gets smaller each time
                    inside = F.when((F.col(f"v{i}") >= a) & (F.col(f"v{i}") <= z), F.col(f"v{i}"))
                    sketch[i, cell] = F.percentile_approx(inside, [0.0, *shares], ACCURACY)
        if not sketch:
            break
    return found | _pick(entries, below, ranks, found)


def _pick(entries: DataFrame, below: list[dict[int, int]], ranks: list[list[int]], found: dict) -> dict[tuple[int, int], float]:
    """Sort the cells ``below`` names, with the rows before them, and take the values at the ranks left."""
    left = [[k for k in own if (i, k) not in found] for i, own in enumerate(ranks)]
    needed = [(i, cell, rows) for i, own in enumerate(below) if left[i] for cell, rows in own.items()]
    if not needed:
        return {}
    start = F.create_map(*[x for i, cell, rows in needed for x in (F.lit(f"{i}-{cell}"), F.lit(rows).cast("long"))])
    inside = entries.withColumn("start", F.try_element_at(start, F.concat_ws("-", "c", "cell"))).filter("start IS NOT NULL")
    counted = inside.groupBy("c", "cell", "start", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c", "cell").orderBy("v")
    upto = counted.withColumn("upto", F.col("start") + F.sum("n").over(w))
    # A value covers a wanted rank when more ranks lie below its last place than below its first;
    # Bucketizer counts them by binary search. At most one row per rank.
    covers: Column = F.lit(False)
    for i, own in enumerate(left):
        if not own:
            continue
        places = [float("-inf"), *map(float, own), float("inf")]
        for name, place in (("last", F.col("upto") - 1), ("before", F.col("upto") - F.col("n") - 1)):
            upto = upto.withColumn(f"{name}{i}", F.when(F.col("c") == i, place.cast("double")).otherwise(-1.0))
        upto = Bucketizer(splitsArray=[places, places], inputCols=[f"last{i}", f"before{i}"], outputCols=[f"l{i}", f"b{i}"]).transform(upto)
        covers |= F.col(f"l{i}") > F.col(f"b{i}")
    out = {}
    for r in upto.filter(covers).select("c", "v", "n", "upto").collect():
        for k in left[r["c"]]:
            if r["upto"] - r["n"] <= k < r["upto"]:
                out[r["c"], k] = r["v"]
    return out
