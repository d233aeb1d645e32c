import pytest
from pyspark.sql import functions as F

from corpuslab.operators import graph
from tests.conftest import rows

# 5 is a sink, 3 links to itself, 4 has no incoming edge
EDGES = [(1, 2), (2, 3), (3, 3), (3, 5), (4, 1), (4, 5)]


def ranks_by_hand(rounds):
    out = {v: [d for s, d in EDGES if s == v] for v in range(1, 6)}
    rank = dict.fromkeys(out, 1.0)
    for _ in range(rounds):
        rank = {v: 0.15 + 0.85 * sum(rank[s] / len(out[s]) for s in out if v in out[s]) for v in out}
    return rank


@pytest.mark.parametrize("rescale", [False, True])
def test_pagerank(spark, rescale):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    found = {r["id"]: r["pagerank"] for r in graph.pagerank(edges, rescale=rescale).collect()}
    want = ranks_by_hand(6)
    scale = 5 / sum(want.values()) if rescale else 1
    assert found == pytest.approx({v: x * scale for v, x in want.items()})
    if rescale:
        assert sum(found.values()) == pytest.approx(5)


def test_pagerank_with_heavy_sources(spark, large):
    edges = spark.createDataFrame([(0, d) for d in range(1, 300)] + EDGES, "src long, dst long")
    assert sum(r["pagerank"] for r in graph.pagerank(edges).collect()) == pytest.approx(300)


def test_links_are_distinct_per_source_and_null_is_skipped(spark):
    df = spark.createDataFrame([(1, [(2, "a"), (2, "b"), (1, "c")]), (3, None)], "id long, links array<struct<id:long,text:string>>")
    edges = graph.edges_from_links(df, "id", "links")
    assert rows(edges) == [(1, 1), (1, 2)]
    assert rows(graph.vertices(edges, df)) == [(1,), (2,), (3,)]


WEIGHTED = [(1, 2, 7), (1, 3, 9), (1, 6, 14), (2, 3, 10), (2, 4, 15), (3, 4, 11), (3, 6, 2), (4, 5, 6), (6, 5, 9)]


def test_shortest_paths_and_routes(spark):
    edges = spark.createDataFrame(WEIGHTED, "src long, dst long, weight long")
    paths = graph.shortest_paths(edges, spark.createDataFrame([(1,)], "id long"))
    assert rows(paths.fillna(0)) == [(1, 0, 0), (2, 7, 1), (3, 9, 1), (4, 20, 3), (5, 20, 6), (6, 11, 3)]
    route = graph.routes(paths, spark.createDataFrame([(5,), (99,)], "id long"))
    assert rows(route, "target", "hop", "id") == [(5, 0, 5), (5, 1, 6), (5, 2, 3), (5, 3, 1)]


def test_paths_with_heavy_sources(spark, large):
    edges = spark.createDataFrame(WEIGHTED, "src long, dst long, weight long")
    start = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.shortest_paths(edges, start), "id", "dist") == [(1, 0), (2, 7), (3, 9), (4, 20), (5, 20), (6, 11)]
    assert rows(graph.bfs(edges, start)) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 1)]


def test_edges_of_a_source_lie_in_one_row_and_rounds_leave_them_there(spark):
    edges = spark.createDataFrame([*WEIGHTED, (1, 2, None), (None, 4, 1)], "src long, dst long, weight long")
    ways, heavy = graph._ways(edges)
    try:
        assert heavy is None
        key = lambda way: (way[0], way[1] or 0)
        got = {r["src"]: sorted(((w["dst"], w["weight"]) for w in r["ways"]), key=key) for r in ways.collect()}
        want = {s: sorted(((d, w) for o, d, w in [*WEIGHTED, (1, 2, None), (None, 4, 1)] if o == s), key=key) for s in (1, 2, 3, 4, 6, None)}
        assert got == want
        front = spark.range(9).select(F.col("id").alias("src")).hint("merge")
        plan = front.join(ways, "src")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1  # that of the front
    finally:
        ways.unpersist()


def test_edges_of_a_heavy_source_lie_in_rows_by_salt(spark, large):
    edges = spark.createDataFrame([(0, d, 1) for d in range(300)], "src long, dst long, weight long")
    ways, heavy = graph._ways(edges)
    found = ways.collect()
    ways.unpersist()
    assert heavy.count() == 1 and 1 < len(found) <= 64
    assert sorted(w["dst"] for r in found for w in r["ways"]) == list(range(300))


def test_grid_edges(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5)], "row long, col long")
    assert graph.grid_edges(cells).count() == 6
    assert graph.grid_edges(cells, moves=4).count() == 4


def test_assignment_equals_brute_force(spark, sf):
    requests = [(i, i % 3, "ab"[i % 2]) for i in range(20)]
    spots = [(j, j % 3, float(j * 7 % 11), j * 5 % 4, "ab"[j % 2]) for j in range(12)]
    found = graph.assign(
        spark.createDataFrame(requests, "request_id long, zone int, kind string"),
        spark.createDataFrame(spots, "spot long, zone int, distance double, load long, kind string"), 1.0, 2.0, 3.0)
    want = sorted(
        (r, *min(((s, d + 2.0 * l + (0.0 if k == kind else 3.0)) for s, z, d, l, k in spots if z == zone), key=lambda p: (p[1], p[0])))
        for r, zone, kind in requests)
    assert rows(found) == want
