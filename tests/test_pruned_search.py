"""Pruned search against the plain one, and held spots against request by request acceptance."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuslab.catalog import fixtures
from corpuslab.operators import assignment, blockmax, index as ix, retrieve as rt
from corpuslab.plans import buckets, ranking, skew
from tests.conftest import rows


def text_of(rng, words):
    return " ".join(f"word{int(rng.paretovariate(0.6)) % words}" for _ in range(rng.randint(1, 40)))


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(8)
    docs = [(i, text_of(rng, 60)) for i in range(300)] + [(300, ""), (301, None)]
    index = ix.build_index(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", "text", 0)
    queries = [(q, text_of(rng, 80)) for q in range(8)] + [(90, ""), (91, "unknownterm"), (92, "word1"), (93, None)]
    return index, blockmax.build_blocks(index, block_docs=8), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_pruned_search_gives_the_same_rows(searched, k):
    index, blocks, queries = searched
    found = blockmax.search_bm25(queries, blocks, k)
    columns = ["query_id", "rank", "doc_id", "score"]
    assert rows(found.hits, *columns) == rows(rt.search_bm25(queries, index, k=k), *columns)
    report = found.report.collect()
    assert all(r["postings_read"] <= r["postings"] for r in report)
    if k == 1:
        assert sum(r["postings_read"] for r in report) < 0.7 * sum(r["postings"] for r in report)


def test_pruned_search_of_many_queries(searched, large):
    index, blocks, queries = searched
    columns = ["query_id", "rank", "doc_id", "score"]
    assert rows(blockmax.search_bm25(queries, blocks, 3).hits, *columns) == rows(rt.search_bm25(queries, index, k=3), *columns)


def test_blocks_hold_each_posting_once(searched):
    index, blocks, _ = searched
    flat = blocks.lists.select("term", "block", "n", "most", F.explode("postings").alias("p")).cache()
    assert rows(flat.select("term", "p.doc_id")) == rows(index.postings.select("term", "doc_id"))
    assert flat.groupBy("term", "block").agg((F.max("p.part") == F.first("most")).alias("same"), (F.count("p") == F.first("n")).alias("n")).filter("NOT same OR NOT n").count() == 0
    assert flat.groupBy("p.doc_id").agg(F.countDistinct("block").alias("n")).filter("n > 1").count() == 0
    assert flat.groupBy("block").agg(F.countDistinct("p.doc_id").alias("n")).filter("n > 8").count() == 0


def test_lists_lie_by_block(spark, searched):
    """What is asked of lists by block and term needs no shuffle of them, whatever they are joined with."""
    index, blocks, queries = searched
    given = {name: spark.conf.get(name) for name in (buckets.AUTO, buckets.ALL_KEYS)}
    stored = blocks.described()
    with buckets.together(spark):
        sums = stored.read().groupBy("block", "term").count()
        pairs = stored.read().join(sums.hint("shuffle_hash"), ["block", "term"])
        assert pairs.count() == blocks.lists.count()
        for df in (sums, pairs):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    stored.close()
    blockmax.search_bm25(queries, blocks, 3).hits.count()
    assert spark.sql("SHOW TABLES").count() == 0
    assert given == {name: spark.conf.get(name) for name in given}


def test_blocks_of_many_terms_and_of_postings_alone(spark, searched, monkeypatch):
    """Terms that cannot all be broadcast, documents that lie elsewhere, and an index without the counts of its rows."""
    index, blocks, queries = searched
    columns = ["term", "block", "n", "most", "postings"]
    want = rows(blocks.lists, *columns)
    assert rows(blockmax.build_blocks(replace(index, counted=None), block_docs=8).lists, *columns) == want
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    frequent, rare = blockmax._by_frequency(index.terms.select("term", "df"))
    assert frequent.count() <= 5 and rare.count() > 0
    assert rows(blockmax.build_blocks(index, block_docs=8).lists, *columns) == want


def test_relevant_documents_of_few_queries(spark, tmp_path, monkeypatch):
    """Few queries travel to the postings, which are neither salted nor shuffled."""
    docs = [(0, "alpha beta"), (1, "beta gammas"), (2, "gammas"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "beta gammas"), (2, "beta"), (3, ""), (4, "unseen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(fixtures, "salted_join", None)
    assert rows(fixtures.relevant(spark, str(tmp_path))) == [(1, 1), (1, 2), (2, 0), (2, 1)]


def test_places_of_large_groups(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.randrange(20), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(5)
    got = {r["id"]: r["place"] for r in ranking.group_places(df, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    for g in "ab":
        ordered = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))
        assert [got[d[2]] for d in ordered] == list(range(1, len(ordered) + 1))


def accept(requests, scores, classes):
    """Deferred acceptance, one proposal at a time. A spot ranks by score, class, order and request."""
    lists = {r: sorted((s, spot) for spot, s in scores[c].items()) for r, c, _ in requests}
    rank = {r: (classes.index(c), t, r) for r, c, t in requests}
    held, at, free = {}, {r: 0 for r, _, _ in requests}, [r for r, _, _ in requests]
    while free:
        r = free.pop()
        if at[r] == len(lists[r]):
            continue
        score, spot = lists[r][at[r]]
        at[r] += 1
        if spot not in held or (score, *rank[r]) < held[spot][0]:
            if spot in held:
                free.append(held[spot][1])
            held[spot] = ((score, *rank[r]), r)
        else:
            free.append(r)
    return {r: (spot, key[0]) for spot, (key, r) in held.items()}


@pytest.mark.parametrize("seed", range(4))
def test_held_spots_equal_request_by_request(spark, seed):
    rng = random.Random(seed)
    spots = [(z, 100 * z + i, rng.choice("ab"), float(rng.randrange(4))) for z in (1, 2) for i in range(12)]
    distances = [(z, t, s, float(rng.randrange(6))) for z, s, _, _ in spots for t in "xy" if rng.random() < 0.9]
    requests = [(i, rng.choice([1, 2, 3]), rng.choice("xy"), rng.choice("ab"), rng.randrange(5)) for i in range(30)]
    found = assignment.assign_spots(
        spark.createDataFrame(requests, "request_id int, zone int, target string, kind string, at int"),
        spark.createDataFrame(spots, "zone int, spot int, kind string, load double"),
        spark.createDataFrame(distances, "zone int, target string, spot int, distance double"), [F.asc("at")], 1.0, 0.5, 2.0)
    got = {r["request_id"]: (r["spot"], r["score"]) for r in found.collect()}
    assert len(got) == len(requests)
    classes = sorted({r[1:4] for r in requests})
    facts = {s: (kind, load) for _, s, kind, load in spots}
    scores = {c: {s: round(d + 0.5 * facts[s][1] + 2.0 * (facts[s][0] != c[2]), 6) for z, t, s, d in distances if (z, t) == c[:2]} for c in classes}
    want = accept([(r[0], r[1:4], r[4]) for r in requests], scores, classes)
    assert {r: v for r, v in got.items() if v[0] is not None} == want
    used = [v[0] for v in got.values() if v[0] is not None]
    assert len(used) == len(set(used))
