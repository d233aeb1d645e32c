import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import grid
from corpuslab.plans.storage import new_path
from corpuslab.sources import corpus, gridfiles, index_store, keyvalue
from corpuslab.streaming import live
from tests.conftest import rows

CELL = "sheet_id long, row_idx long, col_idx long, value string"
# 3 x 4 with repeats and mixed case; (1, 2) and (2, 3) are empty
GRID = [["a", "B", "a", "x"], ["b", "A", "", "y"], ["a", "c", "X", ""]]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(1, r, c, v) for r, line in enumerate(GRID) for c, v in enumerate(line) if v], CELL)


@pytest.fixture(scope="module")
def sheets(spark):
    return spark.createDataFrame([(1, 3, 4)], "sheet_id long, n_rows long, n_cols long")


def test_get(spark, cells, sheets):
    asked = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 0), (1, 0, -1), (7, 0, 0)], "sheet_id long, row_idx long, col_idx long")
    found = {(r["sheet_id"], r["row_idx"], r["col_idx"]): (r["in_bounds"], r["value"]) for r in grid.get(cells, sheets, asked, strict=False).collect()}
    assert found == {(1, 0, 1): (True, "B"), (1, 1, 2): (True, ""), (1, 3, 0): (False, None), (1, 0, -1): (False, None), (7, 0, 0): (False, None)}
    with pytest.raises(Exception, match="out of bounds"):
        grid.get(cells, sheets, asked).collect()


def test_get_with_many_requests(spark, cells, sheets, large):
    asked = spark.range(200).select(F.lit(1).cast("long").alias("sheet_id"), (F.col("id") % 3).alias("row_idx"), F.lit(0).cast("long").alias("col_idx"), "id")
    found = grid.get(cells, sheets, asked).collect()
    assert len(found) == 200 and all(r["value"] == GRID[r["row_idx"]][0] for r in found)


def test_put_last_writer_wins(spark, cells, sheets):
    edits = spark.createDataFrame([(1, 0, 0, "old", 1), (1, 0, 0, "new", 5), (1, 2, 3, "fill", 2)], CELL + ", seq long")
    found = {(r["row_idx"], r["col_idx"]): r["value"] for r in grid.put(cells, edits, sheets).collect()}
    assert found[0, 0] == "new" and found[2, 3] == "fill" and found[0, 1] == "B" and len(found) == 11
    with pytest.raises(Exception, match="out of bounds"):
        grid.put(cells, spark.createDataFrame([(1, 9, 0, "x", 1)], CELL + ", seq long"), sheets).collect()


def test_find(cells, sheets):
    def at(**scope):
        return [r[1:] for r in rows(grid.find_first(cells, "a", **scope))]

    assert at() == [(0, 0)] and at(row=2) == [(2, 0)] and at(col=2) == [(0, 2)]
    assert at(row1=1, row2=2, col1=0, col2=3) == [(2, 0)] and at(row=1) == []
    assert rows(grid.find_first(cells, "", sheets=sheets)) == [(1, 1, 2)]
    assert len(rows(grid.find_all(cells, "a"))) == 3 and len(rows(grid.find_all(cells, "a", case_sensitive=False))) == 4
    with pytest.raises(ValueError):
        grid.find_all(cells, "")


def test_edit_whole_sheet(cells, sheets):
    wide = [r[2:] for r in rows(grid.to_wide(grid.replace_all(cells, "A", "z", case_sensitive=False), 4))]
    assert wide[0] == ("z", "B", "z", "x") and wide[1] == ("b", "z", "", "y")
    assert [r[2:] for r in rows(grid.to_wide(grid.swap_rows(cells, 0, 2), 4))][0] == ("a", "c", "X", "")
    assert [r[2:] for r in rows(grid.to_wide(grid.swap_cols(cells, 0, 3), 4))][0] == ("x", "B", "a", "a")
    moved, grown = grid.insert_row(cells, sheets, 0)
    assert rows(grid.size(grown)) == [(1, 4, 4)] and [r[1] for r in rows(grid.to_wide(moved, 4))] == [0, 2, 3]
    with pytest.raises(Exception, match="out of bounds"):
        grid.insert_col(cells, sheets, 4)[1].collect()


def test_grid_file_round_trip(spark):
    path = new_path(spark, "grid")
    data = [(0, 0, "two words"), (0, 2, "100%20"), (2, 1, "line\nbreak")]
    gridfiles.write_grid(spark.createDataFrame(data, "row_idx long, col_idx int, value string"), 3, 3, path)
    found, n_rows, n_cols = gridfiles.read_grid(spark, path)
    assert (n_rows, n_cols) == (3, 3) and rows(found) == data


def test_plain_grid_file(spark, tmp_path):
    (tmp_path / "g.txt").write_text("2,3\na b c\n  d\n")
    found, n_rows, n_cols = gridfiles.read_grid(spark, str(tmp_path / "g.txt"))
    assert (n_rows, n_cols) == (2, 3) and rows(found) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 2, "d")]


def test_pageviews(spark, tmp_path):
    (tmp_path / "views.txt").write_text(
        "en.wikipedia A 12 desktop 7 X\nen.wikipedia B null desktop 7 X\nen.wikipediax C 1 d 1 X\nde.wikipedia D 5 d 5 X\nen.wikipedia E 12 m 3\nen.wikipedia F\n")
    assert rows(corpus.read_pageviews(spark, str(tmp_path))) == [(12, 3), (12, 7)]


def test_query_set_and_words(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"best cities": [1, 2], "empty": []}')
    assert rows(corpus.read_query_set(spark, str(tmp_path / "q.json"))) == [("best cities", 1), ("best cities", 2)]
    (tmp_path / "w.txt").write_text("the\n\n  of \n")
    assert rows(corpus.read_words(spark, str(tmp_path / "w.txt"))) == [("of",), ("the",)]


def test_excluded_files_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    assert corpus.read_corpus(spark, str(tmp_path / "t")).count() == 1
    assert corpus.read_corpus(spark, str(tmp_path / "t"), exclude=("part-",)).count() == 0


def test_key_tables(spark):
    df = spark.createDataFrame([(i * 7 % 100, f"t\t{i}") for i in range(100)], "id long, title string")
    path = new_path(spark, "kv")
    keyvalue.write_kv(df, path, fmt="text")
    assert rows(keyvalue.read_kv(spark, path, "title", "string")) == rows(df)
    path = new_path(spark, "kv")
    keyvalue.write_kv(df, path)
    parts = keyvalue.sortedness(spark, path).collect()
    assert sum(p["breaks"] for p in parts) == 0 and sum(p["n_rows"] for p in parts) == 100
    path = new_path(spark, "kv")
    df.coalesce(1).write.parquet(path)
    assert sum(p["breaks"] for p in keyvalue.sortedness(spark, path).collect()) > 0


def test_index_files(spark):
    from corpuslab.operators import index as ix, retrieve as rt

    docs = spark.createDataFrame([(i, f"word{i % 5} common other{i}") for i in range(40)], "id long, text string")
    index = ix.build_index(docs, "id", "text", 0)
    path = new_path(spark, "index")
    index_store.write_index(index, path)
    again = index_store.read_index(spark, path)
    assert rows(again.postings.drop("bucket")) == rows(index.postings) and rows(again.terms) == rows(index.terms)
    one = index_store.read_postings(spark, path, ["word3"])
    assert rows(one.select("term").distinct()) == [("word3",)] and one.count() == 8
    queries = spark.createDataFrame([(1, "word3 common")], "query_id long, text string")
    found = rt.search_bm25(queries, again)
    assert rows(found) == rows(rt.search_bm25(queries, index))
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()


def _event(minute, place, delta):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute), place, delta


def test_occupancy_drops_late_events(spark, tmp_path):
    schema = "ts timestamp, place int, delta int"
    folder = str(tmp_path / "in")
    batches = [
        [_event(5, 1, 1), _event(20, 1, 1), _event(200, 1, -1)], [_event(210, 1, 1)], [_event(10, 1, 1), _event(400, 2, 1)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = live.drain(live.occupancy(stream, "place", "delta"), "append", "late")
    # the event at minute 10 comes after the watermark has passed its hour
    assert rows(found, "place", "change", "moves") == [(1, 0, 2), (1, 2, 2)]


def test_latest_cells_stream(spark, tmp_path):
    folder = str(tmp_path / "edits")
    schema = CELL + ", seq long"
    for batch in ([(1, 0, 0, "a", 1), (1, 0, 1, "b", 2)], [(1, 0, 0, "c", 9)], [(1, 0, 0, "late", 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    updates = live.drain(live.latest_cells(stream), "update", "edits")
    assert updates.select("batch").distinct().count() == 3
    assert rows(live.newest(updates, ["sheet_id", "row_idx", "col_idx"])) == [(1, 0, 0, "c", 9), (1, 0, 1, "b", 2)]
