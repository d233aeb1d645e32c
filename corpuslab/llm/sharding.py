"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VNODES places on a ring of cells. A key belongs to the next place
clockwise; when that place's shard is full it continues to the next place of a shard
with room. Rows are taken in the order of a second hash, so the outcome depends on keys
only, not on partitions. Shard capacities add up to the number of rows and differ by one
at most, so counts do too.

In that order one shard after another fills up, and between two such moments each place
has one fixed shard. So the work is a few passes that count rows per shard and hash
range, which find the row that fills a shard, and one pass that looks up each row's shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from corpuslab.llm.common import bucket_rank, quoted
from corpuslab.plans.storage import written

SHARDS = 8
VNODES = 128
CELLS = 1 << 16
# Hash ranges counted in one pass, and the most rows that the driver looks at one by one.
RANGES = 1024
LOOK = 4096
ORDER_BITS = 62


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of the places, clockwise. A shard's places do not depend on other shards."""
    taken: dict[int, tuple[str, int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = hashlib.md5(f"{s}/{v}".encode()).hexdigest()
            cell = int(at[:8], 16) % CELLS
            taken[cell] = min(taken.get(cell, (at, s)), (at, s))
    return [(cell, taken[cell][1]) for cell in sorted(taken)]


def first_open(places: list[tuple[int, int]], full: set[int]) -> list[int]:
    """For each place, the first shard clockwise from it, itself included, that is not full."""
    out = [-1] * len(places)
    shard = -1
    for i in [*range(len(places) - 1, -1, -1)] * 2:
        if places[i][1] not in full:
            shard = places[i][1]
        out[i] = shard
    return out


def keyed(docs: DataFrame, places: list[tuple[int, int]], text: str, id_col: str) -> DataFrame:
    """(id, size, crc, arc, turn, row): ``arc`` numbers the place of the key, (turn, row) orders the rows."""
    spark = docs.sparkSession
    cells = [c for c, _ in places]
    arcs = []
    at = 0
    for cell in range(CELLS):
        while at < len(cells) and cells[at] < cell:
            at += 1
        arcs.append((cell, at % len(cells)))
    # a fixed number of CELLS rows
    lookup = F.broadcast(spark.createDataFrame(arcs, "cell int, arc int"))
    key, given = F.col(quoted(id_col)), F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(
        key.alias("id"), (F.octet_length(given) + 1).cast("long").alias("size"),
        F.crc32(given.cast("binary")).alias("crc"),
        F.pmod(F.xxhash64(F.lit("ring"), key), F.lit(CELLS)).cast("int").alias("cell"),
        F.shiftrightunsigned(F.xxhash64(F.lit("turn"), key), 64 - ORDER_BITS).alias("turn"),
        F.monotonically_increasing_id().alias("row"))
    return written(rows.join(lookup, "cell").drop("cell"), "keys")


def fill(rows: DataFrame, places: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, list[int]]]:
    """Phases (turn, row, shard per arc): rows up to and with (turn, row) go by that map, in turn.

    The driver holds loads, RANGES * shards counts at most, or LOOK rows at most.
    """
    spark = rows.sparkSession
    load = [0] * len(room)
    full = {s for s, n in enumerate(room) if n == 0}
    if len(full) == len(room):
        return []
    route = first_open(places, full)
    phases: list[tuple[int, int, list[int]]] = []
    span = rows.agg(F.min("row"), F.max("row")).first()
    # unseen rows, in order: ranges of (turn) or, within one turn, of (row); the last entry comes first
    todo = [("turn", 0, 1 << ORDER_BITS, F.lit(True))]
    while todo:
        column, low, high, where = todo.pop()
        part = rows.filter(where & (F.col(column) >= low) & (F.col(column) < high))
        width = max(1, -(-(high - low) // RANGES))
        mapped = F.broadcast(spark.createDataFrame(list(enumerate(route)), "arc int, shard int"))
        counted = (
            part.join(mapped, "arc").groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("range"), "shard")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
        )
        by_range: dict[int, dict[int, int]] = {}
        for r in counted:
            by_range.setdefault(r["range"], {})[r["shard"]] = r["n"]
        for at, counts in by_range.items():
            if all(load[s] + n < room[s] for s, n in counts.items()):
                for s, n in counts.items():
                    load[s] += n
                continue
            # a shard fills up in this range: look closer, then go on behind it with the new map
            start, stop = low + at * width, min(high, low + (at + 1) * width)
            if stop < high:
                todo.append((column, stop, high, where))
            if sum(counts.values()) > LOOK:
                if stop - start > 1:
                    todo.append((column, start, stop, where))
                else:
                    todo.append(("row", span[0], span[1] + 1, where & (F.col(column) == start)))
                break
            inside = part.filter((F.col(column) >= start) & (F.col(column) < stop))
            for r in inside.select("turn", "row", "arc").orderBy("turn", "row").collect():
                s = route[r["arc"]]
                load[s] += 1
                if load[s] == room[s]:
                    phases.append((r["turn"], r["row"], route))
                    full.add(s)
                    if len(full) == len(room):
                        return phases
                    route = first_open(places, full)
            break
    return phases


def shard_rows(
    docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, size, crc, shard, slot): one row per row of ``docs``; slots of a shard count from 0.

    Null ids are one key, whose rows share a place on the ring like those of any repeated
    id and overflow from it. A null text has no bytes. Counts differ by one at most; a
    shard is empty only if there are fewer rows than shards.
    """
    spark = docs.sparkSession
    places = ring(shards, vnodes)
    rows = keyed(docs, places, text, id_col)
    n = rows.count()
    room = [n // shards + (s < n % shards) for s in range(shards)]
    phases = fill(rows, places, room) if n else []
    # one row per phase and place: at most shards * shards * vnodes
    maps = [(p, arc, s) for p, (_, _, route) in enumerate(phases) for arc, s in enumerate(route)]
    lookup = F.broadcast(spark.createDataFrame(maps, "phase int, arc int, shard int"))
    phase = F.lit(0)
    for turn, row, _ in phases:
        phase += ((F.col("turn") > turn) | ((F.col("turn") == turn) & (F.col("row") > row))).cast("int")
    placed = rows.withColumn("phase", phase).join(lookup, ["phase", "arc"])
    piece = F.shiftright("turn", ORDER_BITS - 12)
    slots = bucket_rank(placed, ["shard"], piece, [F.col("turn"), F.col("row")], F.lit(1), "slot")
    return slots.select("id", "size", "crc", "shard", F.col("slot").cast("long").alias("slot"))


def op5_sharding(spark, sf_dir):
    rows = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
