"""Cell-table operators over many sheets at once.

State is two tables: cells (sheet_id, row_idx, col_idx, value), where an absent
cell inside a sheet is an empty string, and sheets (sheet_id, n_rows, n_cols).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslab.plans.skew import hot_keys, join_small_or_salted, salted_join

KEY = ["sheet_id", "row_idx", "col_idx"]
BLOCK_ROWS = 4096


def _inside(row: Column, col: Column) -> Column:
    return row.between(0, F.col("n_rows") - 1) & col.between(0, F.col("n_cols") - 1)


def _bounded(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows with ``in_bounds``; a request for an unknown sheet is out of bounds."""
    placed = join_small_or_salted(rows, sheets, ["sheet_id"], ["row_idx", "col_idx"], "left")
    inside = F.coalesce(_inside(F.col("row_idx"), F.col("col_idx")), F.lit(False))
    return placed.withColumn("in_bounds", inside).drop("n_rows", "n_cols")


def get(cells: DataFrame, sheets: DataFrame, requests: DataFrame, strict: bool = True) -> DataFrame:
    """Requests (sheet_id, row_idx, col_idx, ...) with their value.

    Out of bounds fails the query, or with ``strict=False`` gives NULL and in_bounds = false.
    """
    rows = _bounded(requests, sheets)
    others = [c for c in requests.columns if c not in KEY] or KEY
    # cells are the large side; a cell that very many requests ask for is spread over tasks
    asked = requests.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n"))
    found = salted_join(rows, cells.select(*KEY, "value"), KEY, hot_keys(asked, KEY, "__n"), others, "left")
    value = F.when(F.col("in_bounds"), F.coalesce("value", F.lit("")))
    if strict:
        value = value.otherwise(F.raise_error(F.lit("cell is out of bounds")))
    return found.withColumn("value", value)


def put(cells: DataFrame, edits: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Apply edits (sheet_id, row_idx, col_idx, value, seq); the highest seq of a cell wins.

    With ``sheets``, an edit outside its sheet fails the query.
    """
    if sheets is not None:
        checked = _bounded(edits, sheets)
        edits = checked.withColumn(
            "value", F.when(F.col("in_bounds"), F.col("value")).otherwise(F.raise_error(F.lit("cell is out of bounds"))))
    base = cells.select(*KEY, "value", F.lit(None).cast("bigint").alias("seq"))
    both = base.unionByName(edits.select(*KEY, "value", F.col("seq").cast("bigint")))
    # NULL sorts first in a struct, so a stored value loses to any edit
    latest = F.max(F.struct("seq", "value")).alias("last")
    return both.groupBy(*KEY).agg(latest).select(*KEY, "last.value")


def _require(sheets: DataFrame, size: str, *indexes: int | None) -> None:
    """An index outside of any sheet is an error."""
    given = [i for i in indexes if i is not None]
    if given and (min(given) < 0 or not sheets.filter(F.col(size) <= max(given)).isEmpty()):
        raise IndexError("index is out of bounds")


def dense(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """All cells of all sheets, absent ones as empty strings. Blocks of rows are opened by different tasks."""
    blocks = sheets.filter("n_rows > 0 AND n_cols > 0").select(
        "sheet_id", "n_rows", "n_cols", F.explode(F.expr(f"sequence(0L, n_rows - 1L, {BLOCK_ROWS}L)")).alias("start"))
    rows = blocks.repartition("sheet_id", "start").select(
        "sheet_id", F.explode(F.expr(f"sequence(start, least(n_rows, start + {BLOCK_ROWS}L) - 1L)")).alias("row_idx"), "n_cols")
    places = rows.select("sheet_id", "row_idx", F.explode(F.expr("sequence(0L, n_cols - 1L)")).alias("col_idx"))
    return places.join(cells, KEY, "left").withColumn("value", F.coalesce("value", F.lit("")))


def _searched(cells: DataFrame, sheets: DataFrame | None, needle: str) -> DataFrame:
    if needle != "":
        return cells
    if sheets is None:
        raise ValueError("searching for empty cells needs the table of sheets")
    return dense(cells, sheets)


def matches(needle: str, case_sensitive: bool = True) -> Column:
    """Whole-cell match."""
    return F.col("value") == needle if case_sensitive else F.lower("value") == needle.lower()


def first_gap(cells: DataFrame, sheets: DataFrame, rows: tuple[int | None, int | None], cols: tuple[int | None, int | None]) -> DataFrame:
    """(sheet_id, row_idx, col_idx): the first empty cell of each sheet in row-major order, within inclusive ranges.

    Only stored cells are read. Their counts per block of rows tell the first block with a gap, counts per
    row of that block the first row, and the row's own cells the column. A sheet that is full there has no row.
    """
    scope = sheets.select(
        "sheet_id", F.lit(rows[0] or 0).cast("long").alias("r1"), F.lit(cols[0] or 0).cast("long").alias("c1"),
        *[(F.least(F.col(size) - 1, F.lit(last)) if last is not None else F.col(size) - 1).cast("long").alias(name)
          for size, last, name in (("n_rows", rows[1], "r2"), ("n_cols", cols[1], "c2"))]).filter("r1 <= r2 AND c1 <= c2")
    filled = join_small_or_salted(cells.filter("value <> ''").select(*KEY), scope, ["sheet_id"], ["row_idx", "col_idx"])
    filled = filled.filter("row_idx BETWEEN r1 AND r2 AND col_idx BETWEEN c1 AND c2")
    block = F.floor((F.col("row_idx") - F.col("r1")) / BLOCK_ROWS)
    height = F.least(F.col("r2") - F.col("r1") + 1 - F.col("at") * BLOCK_ROWS, F.lit(BLOCK_ROWS))
    blocks = filled.groupBy("sheet_id", "r1", "r2", "c1", "c2", block.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    full = blocks.filter(F.col("n") == height * (F.col("c2") - F.col("c1") + 1))
    first = scope.join(_leading(full, "at", F.lit(0)), "sheet_id", "left")
    first = first.withColumn("first", F.col("r1") + F.coalesce("leading", F.lit(0)) * BLOCK_ROWS).drop("leading").filter("first <= r2")
    inside = filled.select(*KEY).join(first, "sheet_id").filter(
        (F.col("row_idx") >= F.col("first")) & (F.col("row_idx") < F.col("first") + BLOCK_ROWS))
    per_row = inside.groupBy("sheet_id", "first", "c1", "c2", "row_idx").agg(F.count(F.lit(1)).alias("n"))
    first = first.join(_leading(per_row.filter(F.col("n") == F.col("c2") - F.col("c1") + 1), "row_idx", F.col("first")), "sheet_id", "left")
    first = first.withColumn("row_idx", F.col("first") + F.coalesce("leading", F.lit(0))).drop("leading")
    in_row = filled.select(*KEY).join(first, ["sheet_id", "row_idx"])
    first = first.join(_leading(in_row, "col_idx", F.col("c1")), "sheet_id", "left")
    return first.select("sheet_id", "row_idx", (F.col("c1") + F.coalesce("leading", F.lit(0))).alias("col_idx"))


def _leading(rows: DataFrame, place: str, start: Column) -> DataFrame:
    """(sheet_id, leading): how many of the distinct places start, start + 1, ... of a sheet come without a gap."""
    w = Window.partitionBy("sheet_id").orderBy(place)
    run = rows.withColumn("__number", F.row_number().over(w) - 1).filter(F.col(place) - start == F.col("__number"))
    return run.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("leading"))


def find_first(
    cells: DataFrame, needle: str, *, row: int | None = None, col: int | None = None, row1: int | None = None,
    row2: int | None = None, col1: int | None = None, col2: int | None = None, sheets: DataFrame | None = None,
) -> DataFrame:
    """(sheet_id, row_idx, col_idx) of the first match in row-major order per sheet.

    The scope is the sheet, one row, one column, or an inclusive range. With ``sheets``,
    a scope that leaves one of them is an error.
    """
    if sheets is not None:
        _require(sheets, "n_rows", row, row1, row2)
        _require(sheets, "n_cols", col, col1, col2)
    if needle == "":
        if sheets is None:
            raise ValueError("searching for empty cells needs the table of sheets")
        if row is None and col is None:
            return first_gap(cells, sheets, (row1, row2), (col1, col2))
        return first_gap(cells, sheets, (row1 if row is None else row, row2 if row is None else row),
                         (col1 if col is None else col, col2 if col is None else col))
    scope = matches(needle)
    for name, low, high in (("row_idx", row, row), ("col_idx", col, col), ("row_idx", row1, row2), ("col_idx", col1, col2)):
        if low is not None:
            scope &= F.col(name) >= low
        if high is not None:
            scope &= F.col(name) <= high
    hits = cells.filter(scope)
    return hits.groupBy("sheet_id").agg(F.min(F.struct("row_idx", "col_idx")).alias("at")).select("sheet_id", "at.*")


def find_all(cells: DataFrame, needle: str, case_sensitive: bool = True, sheets: DataFrame | None = None) -> DataFrame:
    return _searched(cells, sheets, needle).filter(matches(needle, case_sensitive)).select(*KEY)


def replace_all(
    cells: DataFrame, old: str, new: str, case_sensitive: bool = True, sheets: DataFrame | None = None
) -> DataFrame:
    changed = F.when(matches(old, case_sensitive), F.lit(new)).otherwise(F.col("value"))
    return _searched(cells, sheets, old).withColumn("value", changed)


def _swap(cells: DataFrame, axis: str, a: int, b: int) -> DataFrame:
    at = F.col(axis)
    return cells.withColumn(axis, F.when(at == a, F.lit(b)).when(at == b, F.lit(a)).otherwise(at).cast(cells.schema[axis].dataType))


def swap_rows(cells: DataFrame, a: int, b: int, sheets: DataFrame | None = None) -> DataFrame:
    """Rows ``a`` and ``b`` exchanged in every sheet. With ``sheets``, a row outside of one is an error."""
    if sheets is not None:
        _require(sheets, "n_rows", a, b)
    return _swap(cells, "row_idx", a, b)


def swap_cols(cells: DataFrame, a: int, b: int, sheets: DataFrame | None = None) -> DataFrame:
    """Columns ``a`` and ``b`` exchanged in every sheet. With ``sheets``, a column outside of one is an error."""
    if sheets is not None:
        _require(sheets, "n_cols", a, b)
    return _swap(cells, "col_idx", a, b)


def _insert(cells: DataFrame, sheets: DataFrame, axis: str, size: str, after: int) -> tuple[DataFrame, DataFrame]:
    _require(sheets, size, after)
    at = F.col(axis)
    moved = cells.withColumn(axis, F.when(at > after, at + 1).otherwise(at).cast(cells.schema[axis].dataType))
    return moved, sheets.withColumn(size, F.col(size) + 1)


def insert_row(cells: DataFrame, sheets: DataFrame, after: int) -> tuple[DataFrame, DataFrame]:
    """Empty row after ``after``: (cells, sheets)."""
    return _insert(cells, sheets, "row_idx", "n_rows", after)


def insert_col(cells: DataFrame, sheets: DataFrame, after: int) -> tuple[DataFrame, DataFrame]:
    """Empty column after ``after``: (cells, sheets)."""
    return _insert(cells, sheets, "col_idx", "n_cols", after)


def size(sheets: DataFrame) -> DataFrame:
    return sheets.select("sheet_id", "n_rows", "n_cols")


def to_wide(cells: DataFrame, n_cols: int) -> DataFrame:
    """One row per sheet row, a column c0, c1, ... per cell column; absent cells are empty strings."""
    wide = cells.groupBy("sheet_id", "row_idx").pivot("col_idx", list(range(n_cols))).agg(F.first("value"))
    return wide.select("sheet_id", "row_idx", *[F.coalesce(F.col(str(i)), F.lit("")).alias(f"c{i}") for i in range(n_cols)])
