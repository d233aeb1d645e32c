import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.plans import ranking, storage
from corpuslab.plans.quantiles import exact_quantiles
from corpuslab.plans.skew import attach_stats, heaviest, join_small_or_salted, salted_join
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows have key 0."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    other = spark.createDataFrame([(k, f"v{k}") for k in range(0, 50, 2)], "k long, v string")
    counts = skewed.groupBy("k").agg(F.count("*").alias("n"))
    hot = heaviest(counts, ["k"], "n", min_rows=500)
    assert rows(hot) == [(0,)]
    got = salted_join(skewed, other, ["k"], hot, ["id"], how).fillna("-")
    want = skewed.join(other, ["k"], how).fillna("-")
    assert rows(got, *want.columns) == rows(want)


def test_large_sides_are_not_broadcast(spark, skewed, large):
    other = skewed.select("k").distinct().withColumn("v", F.lit(1))
    assert join_small_or_salted(skewed, other, ["k"], ["id"]).count() == 3000


def test_attach_stats(spark, skewed, large):
    got = {(r["k"], r["c"]) for r in attach_stats(skewed, ["k"], ["id"], c=F.count("*")).collect()}
    assert got == {(r["k"], r["count"]) for r in skewed.groupBy("k").count().collect()}


def test_full_rank_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 10)
    data = [(q, d, (d * 7 + q) % 4) for q in range(2) for d in range(95)]
    df = spark.createDataFrame(data, "q int, d long, s int")
    want = sorted((q, d, r) for q in range(2) for r, (d, _) in enumerate(
        sorted(((d, s) for qq, d, s in data if qq == q), key=lambda p: (-p[1], p[0])), 1))
    assert rows(ranking.full_rank(df, "q", "s", "d"), "q", "d", "rank") == want


@pytest.mark.parametrize("n, take", [(1000, 800), (7, 5), (1, 0)])
def test_mark_first_is_exact(spark, n, take):
    df = ranking.mark_first(spark.range(n), F.floor(F.col("__total") * 0.8), F.xxhash64("id"), ["id"], "flag")
    found = rows(df, "id", "flag")
    assert len(found) == n and sum(f for _, f in found) == take
    # the hash is compared as an unsigned number
    order = [i for i, _ in sorted(rows(df.select("id", F.xxhash64("id"))), key=lambda p: p[1] % 2**64)]
    assert {i for i, f in found if f} == set(order[:take])


@pytest.mark.parametrize("interval_rows", [10, 1_000_000])
def test_quantiles_equal_numpy(spark, interval_rows):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=2000), np.zeros(1000), [1e12]])
    b = np.round(rng.exponential(size=3001), 1)
    df = spark.createDataFrame([(float(x), None if i % 5 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    probs = [0.0, 0.02, 0.25, 0.5, 0.731, 0.99, 1.0]
    found = exact_quantiles(df, {"a": probs, "b": probs}, interval_rows)
    assert found["a"] == pytest.approx(list(np.quantile(a, probs)))
    assert found["b"] == pytest.approx(list(np.quantile([y for i, y in enumerate(b) if i % 5], probs)))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "a double"), {"a": [0.5]}) == {"a": [None]}


def test_written_table_has_no_lineage(spark):
    df = storage.written(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert rows(df) == [(i, 2 * i) for i in range(5)]
    assert storage.shared_folder(spark) in df.inputFiles()[0]
