import re
from collections import Counter

from pyspark.sql import functions as F

from corpuslab.functions import text
from tests.conftest import rows

PYTHON_TOKEN = re.compile(r"[\#\@\w](['\-]?\w){2,24}", re.UNICODE)

SAMPLES = [
    "Hello, world! it's a well-known #tag and @user_name",
    "ab abc a-b-c a'b'c -- ''' __x 12 123 1-2-3",
    "x" * 60 + " déjà-vu naïve ÜBER Straße 東京都庁 ελληνικά",
    "", None, "no",
]


def test_tokens_follow_the_pattern(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id int, t string")
    found = {r["id"]: r["x"] for r in df.select("id", text.raw_tokens(F.col("t")).alias("x")).collect()}
    for i, s in enumerate(SAMPLES):
        assert found[i] == [m.group() for m in PYTHON_TOKEN.finditer((s or "").lower())]


def test_stop_words():
    assert len(text.english_stop_words()) == 179
    assert len(text.all_stop_words()) == len({*text.english_stop_words(), *text.CORPUS_STOP_WORDS}) == 200


def test_counts_match_a_counter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    for r in text.term_counts(docs, "doc_id", "text").collect():
        got.setdefault(r["id"], {})[r["term"]] = r["tf"]
    stop = set(text.all_stop_words())
    for r in docs.select("doc_id", "text").collect():
        want = Counter(t for t in (m.group() for m in PYTHON_TOKEN.finditer(r["text"].lower())) if t not in stop)
        assert got.get(r["doc_id"], {}) == dict(want)


def test_rows_are_counted_in_batches(spark):
    lists = [["b", "a", "b", "é", "Z"], [], None, ["a"] * 300, ["𝄞", "\uffee", "a"], [""]]
    df = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(lists)], "id int, t array<string>, other string").coalesce(1)
    counted = text.count_in_row(df, "t")
    assert "MapInArrow" in counted._jdf.queryExecution().executedPlan().toString()
    for r in counted.collect():
        want = lists[r["id"]]
        order = sorted(Counter(want or []).items(), key=lambda c: c[0].encode())
        assert r["other"] == str(r["id"])
        assert (r["counts"] if want is None else [tuple(c) for c in r["counts"]]) == (None if want is None else order)


def test_last_token(spark):
    df = spark.createDataFrame([("Live in Tel_Aviv!",), ("...",), (None,), ("Één TWEE",)], "t string")
    assert [r[0] for r in df.select(text.last_token(F.col("t"))).collect()] == ["aviv", "", "", "twee"]


def test_query_length_is_at_least_one(spark):
    df = spark.createDataFrame([("",), ("alpha beta alpha",)], "t string")
    assert [r[0] for r in df.select(text.query_length(text.tokenize(F.col("t")))).collect()] == [1, 2]
