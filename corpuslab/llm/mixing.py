"""Mixing sources to target weights with a low-discrepancy schedule.

Each source is a stream of its documents in shuffled order, cut into blocks of equal
token count; after its last block it starts over. Slots of the mix are numbered, the
golden-ratio point of a slot falls into the share of one source, and the r-th slot of a
source takes its r-th block. A slot beyond a source's target is left out, and blocks
that the schedule did not reach come at its end, so every source gives its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslab.llm.common import FEW_ROWS, WORD, bucket_rank, free_name, quoted, row_keys
from corpuslab.plans.skew import fits_broadcast
from corpuslab.plans.storage import scratch, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_TOKENS = 512
# floor(2**32 / golden ratio), the step of the low-discrepancy points
GOLDEN = 2654435769
POINTS = 1 << 32
CELL_BITS = 12
SLOT_PIECE = 1 << 16


def tokens(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_no, source_size, target) from one row per source and size.

    Weights repeat over the sources in code-point order, null last. A source's share stops
    at ``cap`` times its size; the excess goes to the others by weight until none is above.
    Sorted by cap over weight, the sources that reach their cap come first, so one pass over
    the sources finds them.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    weighed = (
        sizes.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("wanted", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", F.col("most") / F.col("weight"))
    )
    upto = Window.orderBy("level", "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        weighed.withColumn("full_sum", F.sum("most").over(upto)).withColumn("full_weight", F.sum("weight").over(upto))
        .withColumn("full", F.col("full_sum") + F.col("level") * (F.col("weights") - F.col("full_weight")) <= F.col("wanted"))
        .withColumn("given", F.coalesce(F.max(F.when(F.col("full"), F.col("full_sum"))).over(whole), F.lit(0)))
        .withColumn("used", F.coalesce(F.max(F.when(F.col("full"), F.col("full_weight"))).over(whole), F.lit(0.0)))
    )
    open_share = (F.col("wanted") - F.col("given")) / (F.col("weights") - F.col("used")) * F.col("weight")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(open_share)
    return filled.select("source", "source_no", "source_size", target.alias("target"))


def schedule(quotas: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source_no, rank): the source of every slot and its rank among that source's slots.

    ``quotas``: (source_no, target, need) with need the slots a source must get.
    """
    spark = quotas.sparkSession
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.coalesce(F.sum("target").over(before), F.lit(0.0))
    edge = lambda c: F.floor(c / F.sum("target").over(all_rows) * POINTS)
    spans = (
        quotas.filter("target > 0").withColumn("low", edge(start)).withColumn("high", edge(start + F.col("target")))
        .withColumn("last", F.max("source_no").over(all_rows))
        .withColumn("high", F.when(F.col("source_no") == F.col("last"), F.lit(POINTS)).otherwise(F.col("high")))
        .filter("high > low")
    )
    # at most 2**CELL_BITS + sources rows: the cells of points that each source covers
    width = POINTS >> CELL_BITS
    cells = spans.select("source_no", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("cell"))
    low16, high16 = F.col("slot") % 65536, F.floor(F.col("slot") / 65536) % 65536
    point = (low16 * GOLDEN + (high16 * GOLDEN % 65536) * 65536) % POINTS
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", point)
    slots = slots.withColumn("cell", F.floor(F.col("point") / width))
    placed = slots.join(cells, "cell").filter("point >= low AND point < high").select("slot", "source_no")
    ranked = bucket_rank(placed, ["source_no"], F.floor(F.col("slot") / SLOT_PIECE), [F.col("slot")], F.lit(1), "rank")
    ranked = written(ranked.select("slot", "source_no", "rank"), "slots")
    got = ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("got"))
    late = quotas.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("need > got")
    tail = late.select((F.lit(n_slots) + F.col("source_no")).alias("slot"), "source_no",
                       F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
    return ranked.join(quotas.select("source_no", "need"), "source_no").filter("rank < need").select("slot", "source_no", "rank").unionByName(tail)


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
    weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of the mix and its schedule.

    Rows: (id, size, source_size, target, taken), one per row of ``docs``; ``taken`` counts the
    words that the mix takes, repeats counted, and is zero for a text without words. Schedule:
    (slot, source_no, rank, block, limit), the words of one block that a slot takes. A null
    source is a source of its own. The order within a source is the MD5 of the id, so that
    reruns agree.
    """
    rows = written(docs.select(
        F.col(quoted(id_col)).alias("id"), F.col(quoted(source)).alias("source"), tokens(F.col(quoted(text))).alias("size"),
        F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))).alias("place")), "sizes")
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    quotas = (
        plan.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * cap))
        .withColumn("per_pass", F.ceil(F.col("source_size") / block))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
        .withColumn("over", F.col("quota") - F.col("passes") * F.col("source_size"))
        .withColumn("need", F.col("passes") * F.col("per_pass") + F.ceil(F.col("over") / block))
    )
    n_slots = quotas.agg(F.sum("need")).first()[0] or 0
    slots = schedule(quotas.select("source_no", "target", "need"), n_slots).join(quotas.drop("target", "source"), "source_no")
    slots = (
        slots.withColumn("block", F.col("rank") % F.col("per_pass")).withColumn("pass", F.expr("rank div per_pass"))
        .withColumn("limit", F.least(F.lit(block).cast("long"), F.when(F.col("pass") == F.col("passes"), F.col("over"))
                    .otherwise(F.col("source_size")) - F.col("block") * block))
        .select("slot", "source_no", "rank", "block", "limit")
    )
    known = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop("source")
    # shuffled streams: the first three hex digits cut a source into 4096 pieces
    stream = bucket_rank(known.filter("size > 0"), ["source_no"], F.substring("place", 1, 3),
                         [F.col("place"), F.col("id"), F.col("size")], F.col("size"), "at")
    parts = stream.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    first = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    last = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    joined = parts.withColumn("first", first).withColumn("last", last).join(
        slots.select("source_no", "block", "limit"), ["source_no", "block"], "left")
    took = F.greatest(F.least("last", F.coalesce("limit", F.lit(0).cast("long"))) - F.col("first"), F.lit(0))
    # (source, position) is unique for rows with words, also where ids repeat
    taken = joined.groupBy("source_no", "at", "id", "size", "source_size", "target").agg(F.sum(took).alias("taken"))
    out = ["id", "size", "source_size", "target", "taken"]
    empty = known.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*out).unionByName(empty.select(*out)), slots


def mixed(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a document comes once for each pass that takes words of it."""
    rows, row = row_keys(docs)
    times = free_name(rows, "copies_")
    with scratch(docs.sparkSession) as scope:
        chosen, _ = mix(rows, text, source, id_col=row)
        copies = chosen.filter("taken > 0").select(F.col("id").alias(row), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
        copies = scope.result(copies, "copies")
    joined = rows.join(F.broadcast(copies) if fits_broadcast(copies, FEW_ROWS) else copies, row)
    return joined.select(*[F.col(quoted(c)) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(row)).drop(row)


def op3_mixing(spark, sf_dir):
    rows, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS source_no FROM s),
w AS (SELECT *, CASE source_no % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2 AS most,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS wanted FROM n),
v AS (SELECT *, sum(weight) OVER () AS weights, CAST(most AS DOUBLE) / weight AS level FROM w),
u AS (SELECT *, CAST(sum(most) OVER o AS DOUBLE) AS full_sum, sum(weight) OVER o AS full_weight FROM v
      WINDOW o AS (ORDER BY level, source_no ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, full_sum + level * (weights - full_weight) <= wanted AS is_full FROM u),
g AS (SELECT *, coalesce(max(CASE WHEN is_full THEN full_sum END) OVER (), 0) AS given,
             coalesce(max(CASE WHEN is_full THEN full_weight END) OVER (), 0) AS used FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE)
             ELSE (wanted - given) / (weights - used) * weight END AS target FROM g),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), source_size * 2) AS quota FROM t),
p AS (SELECT doc_id, d.source, size, source_size, target, quota,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (quota // source_size)
            + greatest(0, least(size, quota % source_size - pos)) END AS taken
FROM p
"""
