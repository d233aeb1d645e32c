"""Ranking quality per query. Ranks start at 1; values are rounded to 3 digits, half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

AP_DEPTH = 40


def _r3(x: Column) -> Column:
    return F.bround(x, 3)


def flag_hits(results: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """Results down to ``depth`` with hit = 1 when the document is relevant."""
    relevant = qrels.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return (
        results.filter(F.col("rank") <= depth)
        .select("query_id", "doc_id", "rank")
        .join(relevant, ["query_id", "doc_id"], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(0)))
    )


def running_precision(results: DataFrame, qrels: DataFrame, depth: int = AP_DEPTH) -> DataFrame:
    """Precision at each rank down to ``depth``."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return flag_hits(results, qrels, depth).withColumn("precision", F.sum("hit").over(upto) / F.col("rank"))


def _harmonic(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(_r3(2.0 / (1.0 / a + 1.0 / b)))


def average_precision(results: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = AP_DEPTH) -> DataFrame:
    """Mean precision at the hits among the first k, over the number of hits; 0 without hits."""
    found = running_precision(results, qrels, k).filter("hit = 1")
    mean = found.groupBy("query_id").agg(_r3(F.avg("precision")).alias("ap"))
    return queries.select("query_id").join(mean, "query_id", "left").select(
        "query_id", F.coalesce("ap", F.lit(0.0)).alias("ap")
    )


def at_k(results: DataFrame, qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Precision, recall and F1 at k for every query, also those without results or relevant documents."""
    found = flag_hits(results, qrels, k).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h")
    )
    relevant = qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    row = queries.select("query_id").join(found, "query_id", "left").join(relevant, "query_id", "left")
    row = row.fillna(0, ["n", "h", "m"])
    p = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(_r3(F.try_divide("h", "n")))
    r = F.when(F.col("m") == 0, F.lit(1.0)).otherwise(_r3(F.try_divide("h", "m")))
    row = row.select("query_id", p.alias("precision"), r.alias("recall"))
    return row.withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def precision_at_k(results, qrels, queries, k):
    return at_k(results, qrels, queries, k).select("query_id", "precision")


def recall_at_k(results, qrels, queries, k):
    return at_k(results, qrels, queries, k).select("query_id", "recall")


def f1_at_k(results, qrels, queries, k):
    return at_k(results, qrels, queries, k).select("query_id", "f1")


def results_quality(results: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Harmonic mean of precision at 5 and F1 at 30."""
    p5 = precision_at_k(results, qrels, queries, 5)
    f30 = f1_at_k(results, qrels, queries, 30)
    return p5.join(f30, "query_id").select("query_id", _harmonic(F.col("precision"), F.col("f1")).alias("quality"))


def evaluate(results: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """All metrics of a query set in one table, from one table of flagged results."""
    flagged = running_precision(results, qrels, AP_DEPTH)
    upto = {k: F.col("rank") <= k for k in (5, 30)}
    per_query = flagged.groupBy("query_id").agg(
        _r3(F.avg(F.when(F.col("hit") == 1, F.col("precision")))).alias("ap"),
        *[F.count(F.when(u, 1)).alias(f"n{k}") for k, u in upto.items()], *[F.sum(F.when(u, F.col("hit"))).alias(f"h{k}") for k, u in upto.items()])
    relevant = qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    row = queries.select("query_id").join(per_query, "query_id", "left").join(relevant, "query_id", "left")
    row = row.fillna(0, ["n5", "h5", "n30", "h30", "m"])

    def precision(k: int) -> Column:
        return F.when(F.col(f"n{k}") == 0, F.lit(0.0)).otherwise(_r3(F.try_divide(f"h{k}", f"n{k}")))

    recall = F.when(F.col("m") == 0, F.lit(1.0)).otherwise(_r3(F.try_divide("h30", "m")))
    row = row.select("query_id", F.coalesce("ap", F.lit(0.0)).alias("ap_at_40"), precision(5).alias("p_at_5"),
                     precision(30).alias("p_at_30"), recall.alias("r_at_30"))
    row = row.withColumn("f1_at_30", _harmonic(F.col("p_at_30"), F.col("r_at_30"))).drop("p_at_30")
    return row.withColumn("quality", _harmonic(F.col("p_at_5"), F.col("f1_at_30")))
