"""Registered queries for graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import fixtures as fx
from corpuslab.catalog.fixtures import SQL_LINKS
from corpuslab.catalog.registry import query, table
from corpuslab.functions.scalar import rounded
from corpuslab.operators import assignment as assignment_, graph


def sql_pagerank(edges: str, verts: str, rounds: int = 6, rescale: bool = True) -> str:
    """CTEs ending in pagerank(id, pagerank)."""
    parts = [f"deg AS (SELECT src, count(*) AS d FROM {edges} GROUP BY src)",
             f"pr0 AS (SELECT id, 1.0::DOUBLE AS r FROM {verts})"]
    for i in range(1, rounds + 1):
        parts.append(f"""in{i} AS (SELECT dst AS id, sum(r / d) AS s FROM {edges} JOIN deg USING (src) JOIN pr{i - 1} p ON p.id = src GROUP BY dst),
pr{i} AS (SELECT v.id, 0.15 + 0.85 * coalesce(s, 0) AS r FROM {verts} v LEFT JOIN in{i} USING (id))""")
    scale = "count(*) OVER () / sum(r) OVER ()" if rescale else "1"
    parts.append(f"pagerank AS (SELECT id, r * {scale} AS pagerank FROM pr{rounds})")
    return ",\n".join(parts)


# Parts and suppliers in one id space: parts even, suppliers odd.
SQL_TRADE = "trade AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem)"


def _trade(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()


@query("graph_gr1_link_edges", f"WITH {SQL_LINKS} SELECT DISTINCT src, dst FROM links")
def link_edges(spark, sf):
    return fx.link_edges(spark, sf)


@query("graph_gr2_vertices", f"WITH {SQL_LINKS} SELECT page_id AS id FROM pages UNION SELECT dst FROM links")
def vertices(spark, sf):
    return graph.vertices(fx.link_edges(spark, sf), table(spark, sf, "pages").select(F.col("page_id").alias("id")))


@query("graph_gr3_pagerank", f"""WITH {SQL_TRADE}, verts AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade),
{sql_pagerank("trade", "verts")} SELECT id, round(pagerank, 6) + 0 AS pagerank FROM pagerank""")
def pagerank(spark, sf):
    return graph.pagerank(_trade(spark, sf)).select("id", rounded(F.col("pagerank")).alias("pagerank"))


@query("graph_gr3_pagerank_links", f"""WITH {SQL_LINKS}, edges AS (SELECT DISTINCT src, dst FROM links),
verts AS (SELECT page_id AS id FROM pages UNION SELECT dst FROM links),
{sql_pagerank("edges", "verts", rescale=False)} SELECT id, round(pagerank, 9) + 0 AS pagerank FROM pagerank""")
def pagerank_links(spark, sf):
    edges = fx.link_edges(spark, sf)
    nodes = graph.vertices(edges, table(spark, sf, "pages").select(F.col("page_id").alias("id")))
    return graph.pagerank(edges, nodes, rescale=False).select("id", rounded(F.col("pagerank"), 9).alias("pagerank"))


@query("graph_gr4_partitioned_edges", f"""WITH {SQL_TRADE}
SELECT src, CAST(count(*) AS BIGINT) AS n_edges, CAST(1 AS BIGINT) AS n_parts FROM trade GROUP BY src""")
def partitioned_edges(spark, sf):
    """Each source's edges lie in one of 124 partitions."""
    placed = _trade(spark, sf).repartition(124, "src").withColumn("part", F.spark_partition_id())
    parts = placed.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("src").agg(F.sum("n").alias("n_edges"), F.count(F.lit(1)).alias("n_parts"))


# Both directions between parts and suppliers; the weight is the least quantity traded.
SQL_ROADS = """roads AS (SELECT src, dst, min(w) AS weight FROM (
  SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, CAST(l_quantity AS BIGINT) AS w FROM lineitem UNION ALL
  SELECT l_suppkey * 2 + 1, l_partkey * 2, CAST(l_quantity AS BIGINT) FROM lineitem) GROUP BY src, dst)"""


def _roads(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") * 2).alias("p"), (F.col("l_suppkey") * 2 + 1).alias("s"), F.col("l_quantity").cast("bigint").alias("w"))
    # parts are even and suppliers odd, so that both directions of a pair have the same rows
    pairs = rows.groupBy("p", "s").agg(F.min("w").alias("weight"))
    ends = F.explode(F.array(
        F.struct(F.col("p").alias("src"), F.col("s").alias("dst")), F.struct(F.col("s").alias("src"), F.col("p").alias("dst"))))
    return pairs.select(ends.alias("e"), "weight").select("e.src", "e.dst", "weight")


def _start(spark):
    return spark.range(1, 2).select("id")  # supplier 0


def _walks(rounds: int) -> str:
    """CTEs d0..dN: least distance over at most N edges."""
    parts = ["d0 AS (SELECT 1::BIGINT AS id, 0::BIGINT AS dist)"]
    for i in range(1, rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM d{i - 1} UNION ALL
  SELECT dst, dist + weight FROM d{i - 1} JOIN roads ON src = id) GROUP BY id)""")
    return ",\n".join(parts)


WALK = 24


SQL_PATHS = f"""WITH {SQL_ROADS}, {_walks(WALK)},
prev AS (SELECT d.id, min(p.id) AS pred FROM d{WALK} d JOIN roads ON dst = d.id JOIN d{WALK} p ON p.id = src
  WHERE p.dist + weight = d.dist GROUP BY d.id)
SELECT d.id, d.dist, CASE WHEN d.id <> 1 THEN pred END AS pred FROM d{WALK} d LEFT JOIN prev USING (id)"""


@query("graph_gr5_shortest_paths", SQL_PATHS)
def shortest_paths(spark, sf):
    return graph.shortest_paths(_roads(spark, sf), _start(spark))


@query("graph_gr5_delta_stepping", SQL_PATHS)
def delta_stepping(spark, sf):
    """The same distances, relaxed in intervals of four."""
    return graph.shortest_paths(_roads(spark, sf), _start(spark), delta=4)


@query("graph_gr5_routes", f"""WITH RECURSIVE {SQL_ROADS}, {_walks(WALK)},
prev AS MATERIALIZED (SELECT d.id, min(p.id) AS pred FROM d{WALK} d JOIN roads ON dst = d.id JOIN d{WALK} p ON p.id = src
  WHERE p.dist + weight = d.dist AND d.id <> 1 GROUP BY d.id),
route AS (SELECT d.id AS target, 0 AS hop, d.id FROM d{WALK} d JOIN supplier ON s_suppkey * 2 + 1 = d.id
  UNION ALL SELECT target, hop + 1, pred FROM route JOIN prev USING (id))
SELECT target, CAST(hop AS INTEGER) AS hop, id FROM route""")
def routes(spark, sf):
    paths = graph.shortest_paths(_roads(spark, sf), _start(spark))
    targets = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"))
    return graph.routes(paths, targets)


@query("graph_gr6_reachability", f"""WITH RECURSIVE {SQL_TRADE},
both_ways AS (SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade),
walk AS (SELECT 1::BIGINT AS id, 0 AS hops UNION SELECT dst, hops + 1 FROM walk JOIN both_ways ON src = id WHERE hops < 8)
SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY id""")
def reachability(spark, sf):
    one = _trade(spark, sf)
    edges = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.bfs(edges, _start(spark))


# Walkable cells: users by half-hour slots in which an event took place.
SQL_CELLS = """cells AS (SELECT DISTINCT user_id AS "row", CAST(hour(ts) * 2 + minute(ts) // 30 AS BIGINT) AS col FROM events
  WHERE event_type <> 'error')"""


def _cells(spark, sf):
    slot = (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("bigint")
    return table(spark, sf, "events").filter("event_type <> 'error'").select(
        F.col("user_id").alias("row"), slot.alias("col")).distinct()


@query("graph_gr7_grid_edges", f"""WITH {SQL_CELLS}
SELECT a."row", a.col, b."row" AS to_row, b.col AS to_col FROM cells a JOIN cells b
  ON b."row" IN (a."row" - 1, a."row", a."row" + 1) AND abs(b.col - a.col) <= 1 AND NOT (a."row" = b."row" AND a.col = b.col)""")
def grid_edges(spark, sf):
    return graph.grid_edges(_cells(spark, sf))


@query("graph_gr8_assignment", """
WITH load AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
spots AS (SELECT s_suppkey AS spot, s_nationkey AS zone, s_acctbal AS distance, coalesce(n, 0) AS load,
  CAST(s_suppkey % 5 + 1 AS VARCHAR) AS kind FROM supplier LEFT JOIN load ON l_suppkey = s_suppkey),
req AS (SELECT o_orderkey AS request_id, c_nationkey AS zone, substr(o_orderpriority, 1, 1) AS kind
  FROM orders JOIN customer ON c_custkey = o_custkey),
choice AS (SELECT w.zone, w.kind, min({'score': distance * 0.01 + load * 0.5 + CASE WHEN w.kind = s.kind THEN 0 ELSE 20 END, 'spot': spot}) AS c
  FROM (SELECT DISTINCT zone, kind FROM req) w JOIN spots s USING (zone) GROUP BY w.zone, w.kind)
SELECT request_id, c.spot AS spot, round(c.score, 6) + 0 AS score FROM req JOIN choice USING (zone, kind)""")
def assignment(spark, sf):
    load = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("load"))
    spots = table(spark, sf, "supplier").join(load, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("spot"), F.col("s_nationkey").alias("zone"), F.col("s_acctbal").alias("distance"),
        F.coalesce("load", F.lit(0)).alias("load"), (F.col("s_suppkey") % 5 + 1).cast("string").alias("kind"))
    requests = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"), F.col("c_nationkey").alias("zone"), F.substring("o_orderpriority", 1, 1).alias("kind"))
    found = graph.assign(requests, spots, distance_weight=0.01, load_weight=0.5, kind_weight=20.0)
    return found.withColumn("score", rounded(F.col("score")))


# Targets of a nation: the mean balance of its customers in each market segment. A spot's distance is that of its own.
SQL_HOLD = """load AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
spots AS (SELECT s_suppkey AS spot, s_nationkey AS zone, s_acctbal, coalesce(n, 0) AS load,
  CAST(s_suppkey % 5 + 1 AS VARCHAR) AS kind FROM supplier LEFT JOIN load ON l_suppkey = s_suppkey),
targets AS (SELECT c_nationkey AS zone, c_mktsegment AS target, round(avg(c_acctbal), 2) AS middle FROM customer GROUP BY ALL),
req AS (SELECT o_orderkey AS request_id, o_orderdate, c_nationkey AS zone, c_mktsegment AS target, substr(o_orderpriority, 1, 1) AS kind
  FROM orders JOIN customer ON c_custkey = o_custkey),
class AS (SELECT *, row_number() OVER (ORDER BY zone, target, kind) AS class_no FROM (SELECT zone, target, kind, count(*) AS n FROM req GROUP BY ALL)),
pairs AS (SELECT zone, class_no, n, spot, round(abs(s_acctbal - middle) * 0.01 + load * 0.5 + CASE WHEN c.kind = s.kind THEN 0.0 ELSE 20.0 END, 6) AS score
  FROM class c JOIN targets USING (zone, target) JOIN spots s USING (zone)),
turns AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY score, class_no, spot) AS i FROM pairs),
walk AS (
  SELECT DISTINCT zone, 0::BIGINT AS i, []::BIGINT[] AS spots, []::BIGINT[] AS classes, []::DOUBLE[] AS scores FROM pairs
  UNION ALL
  SELECT zone, i, CASE WHEN ok THEN list_append(spots, spot) ELSE spots END, CASE WHEN ok THEN list_append(classes, class_no) ELSE classes END,
    CASE WHEN ok THEN list_append(scores, score) ELSE scores END
  FROM (SELECT w.zone, t.i, w.spots, w.classes, w.scores, t.spot, t.class_no, t.score,
          NOT list_contains(w.spots, t.spot) AND len(list_filter(w.classes, lambda x: x = t.class_no)) < t.n AS ok
        FROM walk w JOIN turns t ON t.zone = w.zone AND t.i = w.i + 1)),
last AS (SELECT zone, max(i) AS i FROM walk GROUP BY zone),
held AS (SELECT unnest(spots) AS spot, unnest(classes) AS class_no, unnest(scores) AS score FROM walk JOIN last USING (zone, i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY class_no ORDER BY score, spot) AS place FROM held),
queue AS (SELECT request_id, class_no, row_number() OVER (PARTITION BY class_no ORDER BY o_orderdate, request_id) AS place
  FROM req JOIN class USING (zone, target, kind))"""


@query("graph_gr8_held_spots", f"""WITH RECURSIVE {SQL_HOLD}
SELECT request_id, spot, score FROM queue LEFT JOIN placed USING (class_no, place)""")
def held_spots(spark, sf):
    """Each spot held once, by the request that it and the request can agree on.

    Both sides go by the same score, so taking the best pair left, again and again, must give the same.
    """
    load = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("load"))
    spots = table(spark, sf, "supplier").join(load, "s_suppkey", "left").select(
        F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("spot"), (F.col("s_suppkey") % 5 + 1).cast("string").alias("kind"),
        F.coalesce("load", F.lit(0)).alias("load"), "s_acctbal")
    targets = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("target")).agg(
        F.round(F.avg("c_acctbal"), 2).alias("middle"))
    distances = spots.join(targets, "zone").select("zone", "target", "spot", F.abs(F.col("s_acctbal") - F.col("middle")).alias("distance"))
    requests = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"), "o_orderdate", F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("target"),
        F.substring("o_orderpriority", 1, 1).alias("kind"))
    return assignment_.assign_spots(
        requests, spots.drop("s_acctbal"), distances, [F.asc("o_orderdate")], distance_weight=0.01, load_weight=0.5, kind_weight=20.0)
