import math
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import index as ix, ireval, retrieve as rt
from corpuslab.plans import skew
from tests.conftest import rows

DOCS = [
    (1, "Alpha page", "alpha beta beta gamma"),
    (2, "Beta page", "beta delta"),
    (3, None, "alpha alpha alpha epsilon zeta"),
    (4, "Gamma gamma", ""),
]
ANCHORS = [(1, [(2, "beta link"), (2, "beta again"), (None, "lost"), (3, "")]), (2, None), (3, [(1, "alpha beta"), (4, None)]), (4, [])]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, text string")
    pages = spark.createDataFrame(ANCHORS, "id long, anchor_text array<struct<id:long,text:string>>")
    return docs, ix.build_index(docs, "id", "text", 0), ix.build_index(docs, "id", "title", 0), ix.build_anchor_index(pages, "anchor_text", 0)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [(10, "alpha beta alpha"), (11, "the of"), (12, "unknownword"), (13, ""), (14, "gamma page")], "query_id long, text string")


def test_lengths_count_empty_documents(corpus):
    _, body, _, _ = corpus
    assert rows(body.doc_lengths, "id", "dl") == [(1, 4), (2, 2), (3, 5), (4, 0)]
    assert body.n_docs == 4 and body.avgdl == 11 / 4


def test_terms(corpus):
    assert rows(corpus[1].terms)[:2] == [("alpha", 2, 4), ("beta", 2, 3)]


def test_threshold_is_strict(spark):
    docs = spark.createDataFrame([(1, "aaa bbb"), (2, "aaa bbb"), (3, "aaa")], "id long, text string")
    assert rows(ix.build_index(docs, "id", "text", 2).terms, "term") == [("aaa",)]


def test_bm25_by_hand(corpus, queries):
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in rt.search_bm25(queries, corpus[1]).collect()}
    avg = 11 / 4

    def part(tf, df, dl):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert found[10, 1] == pytest.approx(part(1, 2, 4) + part(2, 2, 4), abs=1e-8)
    assert found[10, 3] == pytest.approx(part(3, 2, 5), abs=1e-8)
    assert {q for q, _ in found} == {10, 14}, "queries without known terms give no rows"


def test_cosine_by_hand_and_bounded(corpus, queries):
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in rt.search_tfidf(queries, corpus[1]).collect()}
    idf = math.log(4 / 2)
    rare = math.log(4 / 1)
    q = [(1 + math.log(2)) * idf, idf]
    d1 = [idf, (1 + math.log(2)) * idf, rare]
    want = (q[0] * d1[0] + q[1] * d1[1]) / (math.hypot(*q) * math.sqrt(sum(x * x for x in d1)))
    assert found[10, 1] == pytest.approx(want, abs=1e-8)
    assert all(s <= 1 + 1e-9 for s in found.values())


def test_anchor_counts_occurrences_or_terms(corpus, queries):
    occurrence = rows(rt.search_anchor(queries, corpus[3]), "query_id", "doc_id", "score")
    assert occurrence == [(10, 1, 2), (10, 2, 2)]
    assert rows(rt.search_anchor(queries, corpus[3], "distinct"), "query_id", "doc_id", "score") == [(10, 1, 2), (10, 2, 1)]
    with pytest.raises(ValueError):
        rt.search_anchor(queries, corpus[3], "other")


def test_title_ranks_all_hits(corpus, queries):
    assert rows(rt.search_title(queries, corpus[2]), "query_id", "rank", "doc_id", "score") == [
        (10, 1, 1, 1), (10, 2, 2, 1), (14, 1, 1, 1), (14, 2, 2, 1), (14, 3, 4, 1)]


def _search(spark, corpus, queries):
    docs, body, title, anchor = corpus
    ranks = spark.createDataFrame([(1, 0.5), (2, 3.0)], "id long, pagerank double")
    views = spark.createDataFrame([(3, 10)], "id long, views long")
    return rt.search(queries, body, title, anchor, ranks, views, docs)


def test_fused_search(spark, corpus, queries):
    found = _search(spark, corpus, queries).collect()
    assert {r["query_id"] for r in found} == {10, 14}
    assert all(0 < r["score"] <= 1.1 for r in found)
    for q in (10, 14):
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r["score"], r["doc_id"]) for r in mine] == sorted((-r["score"], r["doc_id"]) for r in mine)
    assert {r["title"] for r in found if r["doc_id"] == 3} == {None}


def test_paths_for_large_data_give_the_same(spark, corpus, queries, monkeypatch):
    def all_results():
        return [rows(f) for f in (
            rt.search_bm25(queries, corpus[1]), rt.search_tfidf(queries, corpus[1]), rt.search_title(queries, corpus[2]),
            rt.search_anchor(queries, corpus[3]), _search(spark, corpus, queries).fillna(""), ix.doc_norms(corpus[1]))]

    small = all_results()
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    assert all_results() == small


def test_row_order_does_not_matter(spark, corpus, queries):
    docs = corpus[0].orderBy(F.desc("id"))
    again = ix.build_index(docs, "id", "text", 0)
    assert rows(rt.search_bm25(queries, again)) == rows(rt.search_bm25(queries, corpus[1]))


MANY = [(i if i % 7 else 5, " ".join(f"word{j}" * (1 + (i * j) % 3 > 1) or "other" for j in range(i % 9 + 1)), i) for i in range(60)]


def _many(spark):
    """Rows of which some have the same id, no id or no text, and an index of them."""
    docs = [(doc, body) for doc, body, _ in MANY] + [(None, "word1 word2 word3"), (None, "word3 word4"), (99, None), (98, "")]
    index = ix.build_index(spark.createDataFrame(docs, "id long, text string"), "id", "text", 0)
    asked = [(1, "word1 word2 word2 word5"), (2, "other word3"), (2, "word3 word4"), (None, "word8"), (3, "nowhere"), (4, "")]
    return index, spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("cells, few", [(rt.CELLS, skew.BROADCAST_ROWS), (40, skew.BROADCAST_ROWS), (40, 1)])
def test_scoring_in_rows_gives_the_rows_of_postings(spark, monkeypatch, cells, few):
    index, asked = _many(spark)
    plain = replace(index, counted=None)
    query = rt.query_terms(asked)
    monkeypatch.setattr(rt, "CELLS", cells)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", few)  # two ids have several rows
    for k in (3, 1000):
        found, want = (
            sorted(map(tuple, rt.search_bm25(asked, i, k=k, query=query).select("query_id", "doc_id", "score", "rank").collect()), key=str)
            for i in (index, plain))
        assert found == want and found


def test_ids_of_one_row_each_keep_the_best_with_ties(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "shared words here" if i % 3 else f"shared other{i}") for i in range(200)], "id long, text string").coalesce(1)
    index = ix.build_index(docs, "id", "text", 0)
    asked = spark.createDataFrame([(1, "shared words"), (2, "words"), (3, "shared")], "query_id long, text string")
    monkeypatch.setattr(rt, "CELLS", 60)
    for k in (5, 150):
        found, want = (rows(rt.search_bm25(asked, i, k=k), "query_id", "doc_id", "score", "rank") for i in (index, replace(index, counted=None)))
        assert found == want and len(found) == min(k, 200) * 2 + min(k, 133)


def test_only_rows_that_may_be_best_are_shuffled(corpus, queries):
    plan = rt.search_bm25(queries, corpus[1])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(query_id" in plan
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan), "no shuffle of a row per query and document"


def test_posting_blocks_stay_bounded(corpus):
    blocks = ix.posting_blocks(corpus[1].postings, block=2).collect()
    assert all(len(r["postings"]) <= 2 for r in blocks)
    assert sum(len(r["postings"]) for r in blocks) == corpus[1].postings.count()


def test_adding_documents_equals_building_at_once(spark, corpus):
    docs = corpus[0]
    grown = ix.add_documents(ix.build_index(docs.filter("id < 3"), "id", "text", 0), docs.filter("id >= 3"), "id", "text")
    assert rows(grown.terms) == rows(corpus[1].terms)
    assert rows(grown.postings) == rows(corpus[1].postings)
    assert grown.avgdl == pytest.approx(corpus[1].avgdl)


def test_lookup_keeps_order_and_repeats(spark):
    ids = spark.createDataFrame([([3, 9, 3],)], "ids array<long>")
    values = spark.createDataFrame([(3, 7)], "id long, views long")
    assert rows(rt.lookup(ids, values, "views", 0)) == [(0, 3, 7), (1, 9, 0), (2, 3, 7)]


# (relevant, predicted, k, metric, value)
METRICS = [
    (range(10), [1, 2, 3], 2, "precision", 1.0), (range(10), [10, 5, 3], 2, "recall", 0.1), (range(10), [], 2, "precision", 0.0),
    ([], [1, 2, 3], 5, "precision", 0.0), ([], [10, 5, 3], 2, "recall", 1.0), (range(10), [], 2, "recall", 0.0),
    ([], [1, 2, 3], 5, "f1", 0.0), (range(10), [], 2, "f1", 0.0), (range(10), [0, 1, 2], 2, "f1", 0.333),
    (range(50), range(5), 30, "f1", 0.182), (range(50), range(10), 30, "f1", 0.333), (range(50), range(30), 30, "f1", 0.75),
    (range(50), range(5), 0, "quality", 0.308), (range(50), range(10), 0, "quality", 0.5), (range(50), range(30), 0, "quality", 0.857),
    (range(50), [-1] * 5 + list(range(5, 30)), 0, "quality", 0.0),
]


def test_metric_cases(spark):
    queries = spark.createDataFrame([(i,) for i in range(len(METRICS))], "query_id long")
    # the five misses of the last case are different unknown documents
    results = spark.createDataFrame(
        [(i, d if d >= 0 else -r, r) for i, m in enumerate(METRICS) for r, d in enumerate(m[1], 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(i, d) for i, m in enumerate(METRICS) for d in m[0]], "query_id long, doc_id long")
    for k in {m[2] for m in METRICS}:
        found = ireval.results_quality(results, qrels, queries) if k == 0 else ireval.at_k(results, qrels, queries, k)
        by_query = {r["query_id"]: r for r in found.collect()}
        for i, (_, _, depth, metric, value) in enumerate(METRICS):
            if depth == k:
                assert by_query[i][metric] == value, METRICS[i]


def test_average_precision_divides_by_hits(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    results = spark.createDataFrame([(1, d, r) for r, d in enumerate([5, 6, 7, 8], 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 5), (1, 8), (1, 99)], "query_id long, doc_id long")
    assert rows(ireval.average_precision(results, qrels, queries)) == [(1, 0.75), (2, 0.0)]


def test_few_terms_travel_to_the_postings(corpus, monkeypatch):
    """With hot terms too, postings are not shuffled where the table of terms is small."""
    index = corpus[1]
    plain = sorted(tuple(r) for r in index.kept_postings().collect())
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1)
    kept = index.kept_postings()
    assert "__salt" not in kept._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in kept.collect()) == plain
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in index.kept_postings().collect()) == plain
