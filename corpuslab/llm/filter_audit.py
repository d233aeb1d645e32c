"""Interaction audit of text filters by potentials of removal games.

Filters are letters; a document has one bit for each filter that it fails. The removal game
of a part gives a coalition of filters the documents that any of them removes. Its
Hart-Mas-Colell potential P obeys P(S) * |S| = v(S) + sum of P(S without i) over i in S, from
the empty coalition up. A filter's Shapley value is the potential of all filters less that
without it, and step k of an order removes the difference between the values of its first
k and k - 1 filters, so neither needs the documents again.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslab.llm.common import map_text, quoted
from corpuslab.plans.storage import written

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SIGNS = re.compile(rb"[#$%&*|]")


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    code_points = int(np.count_nonzero((raw & 0xC0) != 0x80))
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    return (
        (len(words) < MIN_WORDS)
        + 2 * (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words))
        + 4 * (100 * capitals > MAX_CAPITALS_PERCENT * code_points)
        + 8 * (SIGNS.search(text) is not None)
    )


def failures(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "source",
    quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """(part, fails, n, good, toxic): rows of each part by the filters they fail.

    ``fails`` has bit 0 for A (too few words), 1 for B (too many repeats), 2 for C (too many
    capitals), 3 for D (signs) and 4 for E (the text of a smaller id in the whole table). A
    null text is empty, a null part the empty string. A null id comes before and after no other
    and has no label; a row that repeats the smallest id does not fail E. An id counts as good or
    toxic if any of its labels says so. An empty table gives no rows.
    """

    def make():
        def work(texts):
            raw = [(t or "").encode() for t in texts]
            return [[failed(t) for t in raw], [blake2b(t, digest_size=16).digest() for t in raw]]
        return work

    given = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"),
                        F.col(quoted(text)).cast("string").alias("text"))
    fields = [T.StructField("fails", T.IntegerType()), T.StructField("digest", T.BinaryType())]
    rows = written(map_text(given, "text", fields, make, ["id", "part"]), "failures")
    n = F.count(F.lit(1)).alias("n")
    # the first of each text is found and looked up by (digest, id), so that no group of copies meets
    first = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(16))
    keyed = rows.filter("id IS NOT NULL").groupBy("id", "digest", "part", "fails").agg(n)
    copies = keyed.join(first, ["id", "digest"], "left").withColumn("fails", F.col("fails") + F.lit(16) - F.coalesce("first", F.lit(0)))
    each = copies.groupBy("id", "part", "fails").agg(F.sum("n").alias("n"))
    marks = labels.filter(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("id")).agg(*[
        F.max(F.when(F.col(quoted(c)) == 1, 1).otherwise(0)).alias(name) for c, name in ((quality, "good"), (toxic, "toxic"))])
    known = each.join(marks, "id", "left")
    unknown = rows.filter("id IS NULL").groupBy("part", "fails").agg(n).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    both = known.select("part", "fails", "n", "good", "toxic").unionByName(unknown)
    return both.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def removal_games(counts: DataFrame, n_filters: int, weights: list[str]) -> DataFrame:
    """(part, total, v_...): for each weight the values of all coalitions, by their bits, as an array.

    ``counts`` holds (part, fails, weights). A part has at most 2 ** n_filters of its rows, and
    an array as many entries.
    """
    coalitions = 1 << n_filters
    hit = F.when(F.col("fails").bitwiseAND(F.col("coalition")) != 0, 1).otherwise(0)
    spread = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(coalitions - 1))))
    values = spread.groupBy("part", "coalition").agg(F.sum(weights[0]).alias("total"), *[
        F.sum(F.col(w) * hit).alias(w) for w in weights])
    entries = F.array_sort(F.collect_list(F.struct("coalition", *weights)))
    return values.groupBy("part").agg(F.max("total").alias("total"), entries.alias("entries")).select(
        "part", "total", *[F.col("entries")[w].alias(f"v_{w}") for w in weights])


def potential(values: str, n_filters: int) -> Column:
    """The potentials of a game's coalitions, by their bits, times ``n_filters!``, which makes them whole numbers.

    A coalition comes after all coalitions within it.
    """
    smaller = " + ".join(f"IF(s & {1 << i} <> 0, p[s - (s & {1 << i})], 0L)" for i in range(n_filters))
    return F.expr(
        f"aggregate(sequence(1, {(1 << n_filters) - 1}), array(0L), (p, s) -> "
        f"concat(p, array(({factorial(n_filters)} * {values}[s] + {smaller}) div bit_count(s))))")


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the table of :func:`failures`.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley); ``shapley`` is the sum over all orders, the Shapley value times their number.
    """
    k = len(letters)
    everything = (1 << k) - 1
    games = removal_games(counts, k, ["n", "good", "toxic"]).withColumn("potential", potential("v_n", k))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(letters)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def bits(chosen: Column) -> Column:
        return sum((F.when(F.instr(chosen, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))

    order, step = F.col("filter_order"), F.col("step")
    steps = steps.withColumns({"after": bits(order.substr(F.lit(1), step)), "own": bits(order.substr(step, F.lit(1)))})
    before, removed = F.col("after") - F.col("own"), F.col("v_n")[F.col("after")] - F.col("v_n")[F.col("after") - F.col("own")]
    without = F.lit(everything) - F.col("own")
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.col("v_n")[F.col("after")]).alias("kept"),
        removed.alias("removed"),
        (F.col("v_n")[F.col("own")] - removed).alias("redundant"),
        (F.col("v_n")[everything] - F.col("v_n")[without]).alias("unique_fails"),
        (F.col("v_good")[F.col("after")] - F.col("v_good")[before]).alias("good_lost"),
        (F.col("v_toxic")[F.col("after")] - F.col("v_toxic")[before]).alias("toxic_lost"),
        (F.col("potential")[everything] - F.col("potential")[without]).alias("shapley"))


def op11_filter_audit(spark, sf_dir):
    """Five filters over all ``documents`` in all orders, by source; see :func:`failures` for odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(failures(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN m USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
h AS (SELECT *, contains(fails, own) AS hit, translate(fails, earlier, '') <> fails AS gone FROM c, s),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM h GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
