"""Registered queries for cell tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog.registry import query, table
from corpuslab.operators import grid
from corpuslab.streaming import live

# Ten sheets; a row per order, columns status, priority, customer. Some cells are empty.
SQL_CELLS = """cells AS (SELECT * FROM (
  SELECT o_orderkey % 10 AS sheet_id, o_orderkey // 10 AS row_idx, 0::BIGINT AS col_idx, o_orderstatus AS value FROM orders UNION ALL
  SELECT o_orderkey % 10, o_orderkey // 10, 1, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END FROM orders UNION ALL
  SELECT o_orderkey % 10, o_orderkey // 10, 2, CAST(o_custkey AS VARCHAR) FROM orders) WHERE value IS NOT NULL),
sheets AS (SELECT o_orderkey % 10 AS sheet_id, max(o_orderkey // 10) + 1 AS n_rows, 3::BIGINT AS n_cols FROM orders GROUP BY 1)"""


def cells(spark, sf):
    orders = table(spark, sf, "orders")
    values = F.array("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")), F.col("o_custkey").cast("string"))
    return orders.select(
        (F.col("o_orderkey") % 10).alias("sheet_id"), F.floor(F.col("o_orderkey") / 10).alias("row_idx"),
        F.posexplode(values).alias("col_idx", "value")).filter("value IS NOT NULL").withColumn("col_idx", F.col("col_idx").cast("bigint"))


def sheets(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 10).alias("sheet_id")).agg(
        (F.max(F.floor(F.col("o_orderkey") / 10)) + 1).alias("n_rows")).withColumn("n_cols", F.lit(3).cast("bigint"))


SQL_REQUESTS = """req AS (SELECT l_orderkey % 11 AS sheet_id, l_orderkey // 10 AS row_idx, CAST(l_linenumber % 4 AS BIGINT) AS col_idx,
  l_orderkey, l_linenumber, l_partkey FROM lineitem)"""


def _requests(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 11).alias("sheet_id"), F.floor(F.col("l_orderkey") / 10).alias("row_idx"),
        (F.col("l_linenumber") % 4).cast("bigint").alias("col_idx"), "l_orderkey", "l_linenumber", "l_partkey")


@query("grid_gd1_get", f"""WITH {SQL_CELLS}, {SQL_REQUESTS}
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(r.row_idx < n_rows AND r.col_idx < n_cols, false) AS in_bounds,
  CASE WHEN r.row_idx < n_rows AND r.col_idx < n_cols THEN coalesce(value, '') END AS value
FROM req r LEFT JOIN sheets USING (sheet_id) LEFT JOIN cells USING (sheet_id, row_idx, col_idx)""")
def get(spark, sf):
    found = grid.get(cells(spark, sf), sheets(spark, sf), _requests(spark, sf), strict=False)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "in_bounds", "value")


SQL_EDITS = """edits AS (SELECT user_id % 10 AS sheet_id, event_id % 50 AS row_idx, event_id % 3 AS col_idx, event_type AS value, event_id AS seq FROM events)"""


def edits(events):
    return events.select(
        (F.col("user_id") % 10).alias("sheet_id"), (F.col("event_id") % 50).alias("row_idx"), (F.col("event_id") % 3).alias("col_idx"),
        F.col("event_type").alias("value"), F.col("event_id").alias("seq"))


@query("grid_gd2_put", f"""WITH {SQL_CELLS}, {SQL_EDITS},
both_ AS (SELECT *, -1 AS seq FROM cells UNION ALL SELECT * FROM edits)
SELECT sheet_id, row_idx, col_idx, arg_max(value, seq) AS value FROM both_ GROUP BY ALL""")
def put(spark, sf):
    return grid.put(cells(spark, sf), edits(table(spark, sf, "events")), sheets(spark, sf))


def _first_sql(where: str) -> str:
    return f"""WITH {SQL_CELLS}
SELECT sheet_id, best.r AS row_idx, best.c AS col_idx FROM (SELECT sheet_id, min({{'r': row_idx, 'c': col_idx}}) AS best FROM cells
  WHERE {where} GROUP BY sheet_id)"""


@query("grid_gd3_find_first", _first_sql("value = '5-LOW'"))
def find_first(spark, sf):
    return grid.find_first(cells(spark, sf), "5-LOW")


@query("grid_gd3_find_in_row", _first_sql("value = 'F' AND row_idx = 7"))
def find_in_row(spark, sf):
    return grid.find_first(cells(spark, sf), "F", row=7)


@query("grid_gd3_find_in_col", _first_sql("value = '3-MEDIUM' AND col_idx = 1"))
def find_in_col(spark, sf):
    return grid.find_first(cells(spark, sf), "3-MEDIUM", col=1)


@query("grid_gd3_find_in_range", _first_sql("value = '1-URGENT' AND row_idx BETWEEN 20 AND 90 AND col_idx BETWEEN 1 AND 2"))
def find_in_range(spark, sf):
    return grid.find_first(cells(spark, sf), "1-URGENT", row1=20, row2=90, col1=1, col2=2)


@query("grid_gd3_find_empty", f"""WITH {SQL_CELLS},
rows_ AS (SELECT sheet_id, unnest(range(n_rows)) AS row_idx, n_cols FROM sheets),
places AS (SELECT sheet_id, row_idx, unnest(range(n_cols)) AS col_idx FROM rows_)
SELECT sheet_id, best.r AS row_idx, best.c AS col_idx FROM (SELECT sheet_id, min({{'r': row_idx, 'c': col_idx}}) AS best
  FROM places LEFT JOIN cells USING (sheet_id, row_idx, col_idx) WHERE coalesce(value, '') = '' GROUP BY sheet_id)""")
def find_empty(spark, sf):
    return grid.find_first(cells(spark, sf), "", sheets=sheets(spark, sf))


@query("grid_gd3_find_empty_in_range", f"""WITH {SQL_CELLS},
rows_ AS (SELECT sheet_id, unnest(range(n_rows)) AS row_idx, n_cols FROM sheets),
places AS (SELECT sheet_id, row_idx, unnest(range(n_cols)) AS col_idx FROM rows_)
SELECT sheet_id, best.r AS row_idx, best.c AS col_idx FROM (SELECT sheet_id, min({{'r': row_idx, 'c': col_idx}}) AS best
  FROM places LEFT JOIN cells USING (sheet_id, row_idx, col_idx) WHERE coalesce(value, '') = '' AND row_idx BETWEEN 3 AND 60 AND col_idx BETWEEN 1 AND 2 GROUP BY sheet_id)""")
def find_empty_in_range(spark, sf):
    return grid.find_first(cells(spark, sf), "", row1=3, row2=60, col1=1, col2=2, sheets=sheets(spark, sf))


@query("grid_gd4_find_all", f"WITH {SQL_CELLS} SELECT sheet_id, row_idx, col_idx FROM cells WHERE lower(value) = '2-high'")
def find_all(spark, sf):
    return grid.find_all(cells(spark, sf), "2-High", case_sensitive=False)


@query("grid_gd5_replace_all", f"""WITH {SQL_CELLS}
SELECT sheet_id, row_idx, col_idx, CASE WHEN lower(value) = 'f' THEN 'done' ELSE value END AS value FROM cells""")
def replace_all(spark, sf):
    return grid.replace_all(cells(spark, sf), "f", "done", case_sensitive=False)


@query("grid_gd6_swap", f"""WITH {SQL_CELLS}
SELECT sheet_id, CAST(CASE row_idx WHEN 3 THEN 9 WHEN 9 THEN 3 ELSE row_idx END AS BIGINT) AS row_idx,
  CAST(CASE col_idx WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE col_idx END AS BIGINT) AS col_idx, value FROM cells""")
def swap(spark, sf):
    all_sheets = sheets(spark, sf)
    return grid.swap_cols(grid.swap_rows(cells(spark, sf), 3, 9, all_sheets), 0, 2, all_sheets)


@query("grid_gd7_insert", f"""WITH {SQL_CELLS}
SELECT sheet_id, CAST(row_idx + (row_idx > 4)::INT AS BIGINT) AS row_idx, CAST(col_idx + (col_idx > 0)::INT AS BIGINT) AS col_idx,
  value, n_rows + 1 AS n_rows, n_cols + 1 AS n_cols FROM cells JOIN sheets USING (sheet_id)""")
def insert(spark, sf):
    c, s = grid.insert_row(cells(spark, sf), sheets(spark, sf), 4)
    c, s = grid.insert_col(c, s, 0)
    return grid.join_small_or_salted(c, s, ["sheet_id"], ["row_idx", "col_idx"])


@query("grid_gd8_size", f"WITH {SQL_CELLS} SELECT sheet_id, n_rows, n_cols FROM sheets")
def size(spark, sf):
    return grid.size(sheets(spark, sf))


@query("grid_gd9_wide", f"""WITH {SQL_CELLS}
SELECT sheet_id, row_idx, coalesce(max(value) FILTER (col_idx = 0), '') AS c0, coalesce(max(value) FILTER (col_idx = 1), '') AS c1,
  coalesce(max(value) FILTER (col_idx = 2), '') AS c2 FROM cells GROUP BY ALL""")
def wide(spark, sf):
    return grid.to_wide(cells(spark, sf), 3)


# ---- streams ------------------------------------------------------------------------

SQL_MOVES = """moves AS (SELECT ts, user_id % 20 AS place, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS delta FROM events)"""
SQL_CHANGES = f"""{SQL_MOVES}, changes AS (SELECT place, time_bucket(INTERVAL 1 hour, ts) AS start,
  CAST(sum(delta) AS BIGINT) AS change, CAST(count(*) AS BIGINT) AS moves FROM moves GROUP BY ALL),
closed AS (SELECT * FROM changes WHERE start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minute FROM moves))"""


def _moves(events):
    delta = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    return events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).alias("place"), delta.alias("delta"))


def _event_stream(spark, sf):
    return live.read_table_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)


@query("streaming_sr1_occupancy", f"""WITH {SQL_CHANGES}
SELECT place, start, change, moves, CAST(sum(change) OVER (PARTITION BY place ORDER BY start) AS BIGINT) AS level FROM closed""")
def occupancy(spark, sf):
    changes = live.occupancy(_moves(_event_stream(spark, sf)), "place", "delta")
    kept = live.drain(changes, "append", "occupancy").select("place", F.col("start").cast("timestamp_ntz").alias("start"), "change", "moves")
    return live.running_level(kept, "place")


@query("streaming_sr1_occupancy_table", f"WITH {SQL_CHANGES} SELECT place, start, change, moves FROM changes")
def occupancy_table(spark, sf):
    changes = live.occupancy(_moves(table(spark, sf, "events")), "place", "delta")
    return changes.select("place", F.col("start").cast("timestamp_ntz").alias("start"), "change", "moves")


@query("streaming_sr2_latest_cells", f"""WITH {SQL_EDITS}
SELECT sheet_id, row_idx, col_idx, arg_max(value, seq) AS value, max(seq) AS seq FROM edits GROUP BY ALL""")
def latest_cells(spark, sf):
    updates = live.drain(live.latest_cells(edits(_event_stream(spark, sf))), "update", "cells")
    return live.newest(updates, ["sheet_id", "row_idx", "col_idx"])
