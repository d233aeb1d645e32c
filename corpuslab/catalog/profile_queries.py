"""Registered queries for profiling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from corpuslab.catalog.registry import query, table
from corpuslab.catalog.relational_queries import SQL_GAPS, gaps
from corpuslab.functions import scalar
from corpuslab.functions.scalar import rounded
from corpuslab.operators import profile

GAP_COLUMNS = ["o_orderkey", "o_custkey", "price", "priority", "status"]


def off_ties(mean, digits):
    """Round with a nudge: means of prices often end in exactly 5, where two engines round apart."""
    return rounded(mean + F.lit(1e-9), digits)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_pr1_missing", f"WITH {SQL_GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0 AS ratio FROM gaps""" for c in GAP_COLUMNS))
def missing(spark, sf):
    return profile.missing(gaps(spark, sf), GAP_COLUMNS).withColumn("ratio", rounded(F.col("ratio")))


@query("profile_pr2_nunique", f"WITH {SQL_GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM gaps""" for c in GAP_COLUMNS))
def nunique(spark, sf):
    return profile.nunique(gaps(spark, sf), GAP_COLUMNS)


@query("profile_pr3_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS "count", round(avg({c}), 4) + 0 AS mean, round(stddev_samp({c}), 4) + 0 AS std,
min({c}) AS "min", round(quantile_cont({c}, 0.25), 4) + 0 AS q25, round(quantile_cont({c}, 0.5), 4) + 0 AS q50,
round(quantile_cont({c}, 0.75), 4) + 0 AS q75, max({c}) AS "max" FROM lineitem""" for c in NUMBERS))
def describe(spark, sf):
    found = profile.describe(table(spark, sf, "lineitem"), NUMBERS)
    return found.withColumns({c: rounded(F.col(c), 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("profile_pr4_corr_with", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(corr({c}, l_extendedprice), 6) + 0 AS corr FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")))
def corr_with(spark, sf):
    found = profile.corr_with(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return found.withColumn("corr", rounded(F.col("corr")))


@query("profile_pr5_corr_matrix", " UNION ALL ".join(
    [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0 AS corr FROM lineitem" for x in combinations(NUMBERS, 2) for a, b in (x, x[::-1])]
    + [f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in NUMBERS]))
def corr_matrix(spark, sf):
    return profile.corr_matrix(table(spark, sf, "lineitem"), NUMBERS).withColumn("corr", rounded(F.col("corr")))


def _binned_sql(source: str, x: str, y: str, bins: int, digits: int, prefix: str = "") -> str:
    probs = "[" + ", ".join(repr(i / bins) for i in range(bins + 1)) + "]"
    return f"""WITH {prefix}e AS (SELECT list_sort(list_distinct(quantile_cont({x}, {probs}))) AS edges FROM {source}),
b AS (SELECT greatest(len(list_filter(edges[2:len(edges) - 1], lambda v: v < {x})), 0) AS bin, {y} AS y FROM {source}, e WHERE {x} IS NOT NULL)
SELECT CAST(bin AS INTEGER) AS bin, round(avg(y) + 1e-9, {digits}) + 0 AS mean, CAST(count(y) AS BIGINT) AS n FROM b GROUP BY bin"""


@query("profile_pr6_binned_mean", _binned_sql("gaps", "price", "o_custkey", 100, 5, SQL_GAPS + ", "))
def binned_mean(spark, sf):
    return profile.binned_mean(gaps(spark, sf), "price", "o_custkey", 100).withColumn("mean", off_ties(F.col("mean"), 5))


@query("profile_pr6_binned_mean_narrowed", _binned_sql("gaps", "price", "o_custkey", 100, 5, SQL_GAPS + ", "))
def binned_mean_narrowed(spark, sf):
    """The same bins where no more than 100 rows may be sorted together."""
    return profile.binned_mean(gaps(spark, sf), "price", "o_custkey", 100, interval_rows=100).withColumn("mean", off_ties(F.col("mean"), 5))


@query("profile_pr6_binned_mean_ties", _binned_sql("lineitem", "l_quantity", "l_extendedprice", 10, 3))
def binned_mean_ties(spark, sf):
    found = profile.binned_mean(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 10)
    return found.withColumn("mean", off_ties(F.col("mean"), 3))


@query("profile_pr6_binned_text_length", _binned_sql("t", "n", "y", 10, 5, """t AS (
  SELECT CAST(length(text) AS DOUBLE) AS n, quality AS y FROM documents JOIN labels USING (doc_id)), """))
def binned_text_length(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.char_length("text").cast("double").alias("n"), "quality")
    return profile.binned_mean(rows, "n", "quality", 10).withColumn("mean", off_ties(F.col("mean"), 5))


@query("profile_pr7_category_mean", f"WITH {SQL_GAPS} SELECT priority, round(avg(o_custkey) + 1e-9, 5) + 0 AS mean FROM gaps WHERE priority IS NOT NULL GROUP BY 1")
def category_mean(spark, sf):
    return profile.category_mean(gaps(spark, sf), "priority", "o_custkey").withColumn("mean", off_ties(F.col("mean"), 5))


@query("profile_pr8_activity_mean", """
WITH c AS (SELECT user_id, count(*) AS uploads FROM events GROUP BY user_id HAVING count(*) >= 5)
SELECT CAST(uploads AS BIGINT) AS uploads, round(avg(value) + 1e-9, 5) + 0 AS mean, CAST(count(value) AS BIGINT) AS n
FROM events JOIN c USING (user_id) GROUP BY uploads""")
def activity_mean(spark, sf):
    return profile.activity_mean(table(spark, sf, "events"), "user_id", "value").withColumn("mean", off_ties(F.col("mean"), 5))


@query("profile_pr9_hour_mean", "SELECT CAST(hour(ts) AS INTEGER) AS hour, round(avg(value) + 1e-9, 5) + 0 AS mean, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY 1")
def hour_mean(spark, sf):
    return profile.time_mean(table(spark, sf, "events"), F.hour("ts"), "value", "hour").withColumn("mean", off_ties(F.col("mean"), 5))


@query("profile_pr9_day_mean", "SELECT CAST(dayofweek(ts) AS INTEGER) AS day, round(avg(value) + 1e-9, 5) + 0 AS mean, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY 1")
def day_mean(spark, sf):
    day = scalar.sunday_first(scalar.day_of_week(F.col("ts")))
    return profile.time_mean(table(spark, sf, "events"), day, "value", "day").withColumn("mean", off_ties(F.col("mean"), 5))


def _deviation_sql(pairs) -> str:
    parts = [f"""SELECT '{a}' AS left_name, '{b}' AS right_name, {ta} AS left_value, {tb} AS right_value,
  avg(l_extendedprice) AS mean, count(*) AS n FROM lineitem GROUP BY ALL""" for a, ta, b, tb in pairs]
    return f"""WITH m AS ({" UNION ALL ".join(parts)}),
d AS (SELECT *, mean - (SELECT avg(l_extendedprice) FROM lineitem) AS delta FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY left_name, right_name ORDER BY abs(delta) DESC, left_value, right_value) AS rank FROM d)
SELECT left_name, right_name, left_value, right_value, round(mean, 3) + 0 AS mean, CAST(n AS BIGINT) AS n, round(delta, 3) + 0 AS delta,
  CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


def _deviation(spark, sf, pairs):
    found = profile.pair_deviation(table(spark, sf, "lineitem"), pairs, "l_extendedprice")
    return found.withColumns({c: rounded(F.col(c), 3) for c in ("mean", "delta")})


@query("profile_pr10_category_pairs", _deviation_sql([
    ("l_returnflag", "l_returnflag", "l_linestatus", "l_linestatus"),
    ("l_returnflag", "l_returnflag", "l_linenumber", "CAST(l_linenumber AS VARCHAR)"),
    ("l_linestatus", "l_linestatus", "l_linenumber", "CAST(l_linenumber AS VARCHAR)")]))
def category_pairs(spark, sf):
    return _deviation(spark, sf, list(combinations(["l_returnflag", "l_linestatus", "l_linenumber"], 2)))


@query("profile_pr11_category_number", _deviation_sql([
    (a, a, b, f"CAST({b} AS VARCHAR)") for a in ("l_returnflag", "l_linestatus") for b in ("l_quantity", "l_discount")]))
def category_number(spark, sf):
    return _deviation(spark, sf, [(a, b) for a in ("l_returnflag", "l_linestatus") for b in ("l_quantity", "l_discount")])


@query("profile_pr12_histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / w), 29) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem, b GROUP BY 1""")
def histogram(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)


@query("profile_pr13_classes", "SELECT label AS value, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def classes(spark, sf):
    return profile.class_distribution(table(spark, sf, "embeddings"), "label")


@query("profile_pr14_shape", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS n_features, CAST(count(DISTINCT label) AS BIGINT) AS n_classes FROM embeddings""")
def shape(spark, sf):
    return profile.shape(table(spark, sf, "embeddings"), "embedding", "label")


@query("profile_pr15_subset", """
SELECT o_orderkey FROM orders ORDER BY CAST('0x' || substr(md5(o_orderkey || '-42'), 1, 15) AS BIGINT), o_orderkey LIMIT 5000""")
def subset(spark, sf):
    return profile.random_subset(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5000)


@query("profile_pr15_subset_size", "SELECT CAST(least(5000, count(*)) AS BIGINT) AS n, CAST(least(5000, count(*)) AS BIGINT) AS n_ids FROM orders")
def subset_size(spark, sf):
    picked = profile.random_subset(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5000)
    return picked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_ids"))
