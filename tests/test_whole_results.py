"""Results that must not depend on caps, sizes, NULLs or the sign of zero."""

import pytest

from corpuslab.operators import explain, graph, grid, index as ix, profile, relational as rel, retrieve as rt
from corpuslab.plans import skew
from corpuslab.plans.quantiles import exact_quantiles
from corpuslab.plans.storage import new_path
from corpuslab.sources import index_store
from tests.conftest import rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"word{i % 5} common other{i}") for i in range(40)], "id long, text string")


@pytest.mark.parametrize("small", [True, False])
def test_search_with_other_bucket_count(spark, docs, small):
    index = ix.build_index(docs, "id", "text", 0)
    path = new_path(spark, "index")
    index_store.write_index(index, path, buckets=16)
    again = index_store.read_index(spark, path)
    queries = rt.query_terms(spark.createDataFrame([(1, "word3 other7")], "query_id long, text string"))
    got = rt.matches(rt.QueryTerms(queries.terms, small), again).select("term", "doc_id")
    assert rows(got) == rows(rt.matches(queries, index).select("term", "doc_id")) and got.count() == 9
    assert index_store.read_postings(spark, path, ["word3"]).count() == 8


def test_stored_index_takes_more_documents(spark, docs):
    path = new_path(spark, "index")
    index_store.write_index(ix.build_index(docs.filter("id < 20"), "id", "text", 0), path, buckets=16)
    grown = ix.add_documents(index_store.read_index(spark, path), docs.filter("id >= 20"), "id", "text")
    whole = ix.build_index(docs, "id", "text", 0)
    assert rows(grown.postings) == rows(whole.postings) and rows(grown.terms) == rows(whole.terms)
    queries = spark.createDataFrame([(1, "word3 common")], "query_id long, text string")
    assert rows(rt.search_bm25(queries, grown)) == rows(rt.search_bm25(queries, whole))


def test_index_with_threshold_is_not_extended(spark, docs):
    path = new_path(spark, "index")
    index_store.write_index(ix.build_index(docs, "id", "text", 5), path)
    with pytest.raises(ValueError):
        ix.add_documents(index_store.read_index(spark, path), docs, "id", "text")


def test_long_chain(spark):
    n = 104
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, weight double")
    start = spark.createDataFrame([(0,)], "id long")
    assert rows(graph.bfs(edges, start)) == [(i, i) for i in range(n + 1)]
    with pytest.raises(RuntimeError):
        graph.bfs(edges, start, max_iter=3)
    short = edges.filter("src < 6")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(short, start, max_iter=3)
    paths = graph.shortest_paths(short, start)
    assert rows(paths, "id", "dist") == [(i, float(i)) for i in range(7)]
    target = spark.createDataFrame([(6,)], "id long")
    assert rows(graph.routes(paths, target), "hop", "id") == [(h, 6 - h) for h in range(7)]
    with pytest.raises(RuntimeError):
        graph.routes(paths, target, max_hops=2)


def test_nulls_are_no_extremes(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "k long, v double")
    assert rows(rel.extremes(df, "v", "k")) == [(3, 1)]
    explained = spark.createDataFrame([(1, 1.0, 0.5, 2.0), (2, 1.0, 0.5, None), (3, 2.0, 0.7, 4.0)], "k long, a double, phi_a double, p double")
    assert rows(explain.local(explained, ["a"], "k", "p"), "which", "k") == [("high", 3), ("low", 1)]


def test_spot_without_distance_is_not_chosen(spark):
    requests = spark.createDataFrame([(1, "z", "car")], "request_id long, zone string, kind string")
    spots = spark.createDataFrame([(1, "z", "car", None, 0.0), (2, "z", "car", 3.0, 0.0)], "spot long, zone string, kind string, distance double, load double")
    assert rows(graph.assign(requests, spots)) == [(1, 2, 3.0)]


def test_zero_has_one_sign(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (None,)], "v double")
    assert rows(rel.distinct_counts(df, ["v"])) == [("v", 2)]


def test_correlation_of_one_column(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert rows(profile.corr_matrix(df, ["v"])) == [("v", "v", 1.0)]


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert exact_quantiles(df, {"v": [0.5]}) == {"v": [1.5]}


def test_salts_grow_with_the_rows_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 5)
    counts = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 1)], "k string, n long")
    hot = skew.hot_keys(counts, ["k"], "n", min_rows=50)
    assert rows(hot) == [("a", 200), ("b", 64)]
    left = spark.range(1000).selectExpr("'a' AS k", "id")
    right = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    got = skew.salted_join(left, right, ["k"], hot, ["id"])
    assert got.columns == ["k", "id", "v"] and got.count() == 1000


def test_paths_with_a_heavy_source_and_equal_ways(spark, large):
    edges = spark.createDataFrame(
        [(0, i, 1) for i in range(1, 80)] + [(i, 100, 2) for i in range(1, 80)] + [(0, 100, 3), (0, 200, 9), (100, 200, 1)],
        "src long, dst long, weight long")
    got = {r["id"]: (r["dist"], r["pred"]) for r in graph.shortest_paths(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert len(got) == 82 and got[0] == (0, None) and got[100] == (3, 0) and got[200] == (4, 100)
    assert all(got[i] == (1, 0) for i in range(1, 80))


def test_grid_indexes_outside_a_sheet_are_errors(spark):
    cells = spark.createDataFrame([(1, 0, 0, "x")], "sheet_id long, row_idx long, col_idx long, value string")
    sheets = spark.createDataFrame([(1, 2, 3), (2, 5, 5)], "sheet_id long, n_rows long, n_cols long")
    for run in (
        lambda: grid.swap_rows(cells, 0, 2, sheets), lambda: grid.swap_cols(cells, -1, 0, sheets),
        lambda: grid.insert_row(cells, sheets, 2), lambda: grid.find_first(cells, "x", col=3, sheets=sheets),
    ):
        with pytest.raises(IndexError):
            run()
    assert rows(grid.swap_rows(cells, 0, 1, sheets)) == [(1, 1, 0, "x")]


def test_dense_opens_sheets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK_ROWS", 3)
    cells = spark.createDataFrame([(1, 6, 1, "x")], "sheet_id long, row_idx long, col_idx long, value string")
    sheets = spark.createDataFrame([(1, 7, 2), (2, 3, 1), (3, 0, 4)], "sheet_id long, n_rows long, n_cols long")
    want = [(1, r, c, "x" if (r, c) == (6, 1) else "") for r in range(7) for c in range(2)] + [(2, r, 0, "") for r in range(3)]
    assert rows(grid.dense(cells, sheets)) == want


def test_index_files_hold_a_bounded_number_of_postings(spark, tmp_path, monkeypatch):
    """A term of neighbouring ids is cut into several files too."""
    from pathlib import Path

    monkeypatch.setattr(index_store, "ROWS_PER_FILE", 50)
    docs = spark.range(600).selectExpr("id", "concat('often term', id % 7) AS text")
    index = ix.build_index(docs, "id", "text", 0)
    path = str(tmp_path / "index")
    index_store.write_index(index, path, buckets=2)
    assert len(list(Path(path, "postings").rglob("*.parquet"))) > 4
    read = index_store.read_index(spark, path)
    columns = ["term", "doc_id", "tf", "dl"]
    assert sorted(map(tuple, read.postings.select(columns).collect())) == sorted(map(tuple, index.kept_postings().select(columns).collect()))
