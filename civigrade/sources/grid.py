"""Spreadsheet grids to tables: ``file, sheet, row_number, cells array<string>``, any number of sheets at once.

The first rows of a sheet tell its header; which columns it has is told by all its rows. Where every column shows a value right below
the header, columns get the combined names of all header levels, else they keep the titles of the last header row, and those without a
title a generated name. No column that has a title or a value anywhere is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.naming import unique_names_column
from civigrade.functions.text import strip, title_key
from civigrade.functions.values import looks_numeric
from civigrade.operators.joins import attach_counted, number_rows
from civigrade.session import materialise

SHEET = ["file", "sheet"]

# What header inference looks at.
NAVIGATION_SHEETS = ("sumario", "indice", "contents")
HEADER_SEARCH_ROWS = 40
MOST_HEADER_ROWS = 3
FOLLOWING_ROWS = 5
DATA_SAMPLE_ROWS = 6
FEWEST_DATA_CELLS, FEWEST_NUMERIC_CELLS, NUMERIC_SHARE = 3, 2, 0.2
SPARSE_SHARE = 0.1
TITLE_ROWS = 5


def has_value(cell: Column) -> Column:
    """A cell with text that is no generated column name."""
    text = strip(cell)
    return F.coalesce((text != "") & ~F.startswith(F.lower(text), F.lit("__unnamed__")), F.lit(False))


def _populated(cells: Column) -> Column:
    return F.size(F.filter(cells, has_value))


def sheet_sizes(grid: DataFrame) -> DataFrame:
    """Rows and columns (last populated) of every sheet with data; navigation sheets left out."""
    last = F.array_max(F.transform("cells", lambda c, i: F.when(F.coalesce(strip(c) != "", F.lit(False)), i + 1)))
    rows = grid.filter(~title_key(F.col("sheet")).isin(*NAVIGATION_SHEETS)).withColumn("_last", last)
    return (
        rows.filter(F.col("_last").isNotNull())
        .groupBy(*SHEET)
        .agg(F.max("row_number").alias("rows"), F.max("_last").alias("columns"))
    )


def last_values(grid: DataFrame) -> DataFrame:
    """For every sheet the columns with a value and the last row that has one: ``used`` as a list of (at, last)."""
    filled = F.filter(F.transform("cells", lambda c, i: F.when(has_value(c), i)), lambda i: i.isNotNull())
    cells = grid.select(*SHEET, "row_number", F.explode(filled).alias("at"))
    last = cells.groupBy(*SHEET, "at").agg(F.max("row_number").alias("last"))
    return last.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("at", "last"))).alias("used"))


def infer_headers(grid: DataFrame, search_rows: int = HEADER_SEARCH_ROWS) -> DataFrame:
    """Header of every sheet: ``header_rows``, ``columns`` (0-based positions kept), ``names`` and ``combined``.

    A header is searched in the ``search_rows`` rows from the sheet's first row with two values on, so blank rows and titles above, stored
    or not, never hide it. Every sheet of the grid gets a row. ``header_rows`` is empty where none was found; the first row names the
    columns then. ``combined`` tells that the names come from all header levels.
    """
    starts = grid.groupBy(*SHEET).agg(
        F.coalesce(F.min(F.when(_populated(F.col("cells")) >= 2, F.col("row_number"))), F.min("row_number")).alias("_start")
    )
    number = F.col("row_number")
    inside = (number >= F.col("_start") - MOST_HEADER_ROWS) & (number < F.col("_start") + search_rows)
    sample = attach_counted(grid, starts, SHEET).filter(inside | (number == 1))
    numeric = F.size(F.filter("cells", lambda c: has_value(c) & looks_numeric(c)))
    row = F.struct("row_number", "cells", _populated(F.col("cells")).alias("populated"), numeric.alias("numeric"))
    sheets = sample.groupBy(*SHEET).agg(F.sort_array(F.collect_list(row)).alias("rows"), F.max(F.size("cells")).alias("width"))

    def first_row(condition) -> Column:
        return F.get(F.filter("rows", condition), F.lit(0))["row_number"]

    data_row = first_row(
        lambda r: (r["populated"] >= FEWEST_DATA_CELLS)
        & (r["numeric"] >= FEWEST_NUMERIC_CELLS)
        & (r["numeric"] >= r["populated"] * NUMERIC_SHARE)
    )
    fullest = F.array_max(F.transform("rows", lambda r: r["populated"]))
    sheets = sheets.withColumn("data_row", data_row).withColumn("fullest", fullest)
    sheets = sheets.withColumn("text_row", first_row(lambda r: r["populated"] == F.col("fullest")))

    def populated_at(number: Column) -> Column:
        return F.coalesce(F.get(F.filter("rows", lambda r: r["row_number"] == number), F.lit(0))["populated"], F.lit(0))

    start = F.col("data_row") - 1
    for back in range(2, MOST_HEADER_ROWS + 1):
        above = F.col("data_row") - back
        extends = (start == above + 1) & (above >= 1) & (populated_at(above) >= 2)
        start = F.when(extends, above).otherwise(start)
    follows = F.exists(
        "rows",
        lambda r: (r["row_number"] > F.col("text_row")) & (r["row_number"] <= F.col("text_row") + FOLLOWING_ROWS) & (r["populated"] >= 2),
    )
    by_text = F.col("data_row").isNull() & (F.col("fullest") >= 2) & follows
    header_rows = (
        F.when(F.col("data_row") > 1, F.sequence(start, F.col("data_row") - 1))
        .when(by_text, F.array("text_row"))
        .otherwise(F.expr("array()").cast("array<int>"))
    )
    sheets = sheets.withColumn("header_rows", header_rows).withColumn("has_header", F.size("header_rows") > 0)
    sheets = sheets.withColumn("first_data", F.coalesce(F.try_element_at("header_rows", F.lit(-1)) + 1, F.lit(2)))

    labels = F.filter("rows", lambda r: F.when(F.col("has_header"), F.array_contains("header_rows", r["row_number"])).otherwise(r["row_number"] == 1))
    sheets = sheets.withColumn("levels", F.transform(labels, lambda r: F.transform(r["cells"], _label)))
    sample_end = F.when(F.col("data_row").isNotNull(), DATA_SAMPLE_ROWS).otherwise(FOLLOWING_ROWS)
    sheets = sheets.withColumn(
        "samples",
        F.filter("rows", lambda r: (r["row_number"] >= F.col("first_data")) & (r["row_number"] < F.col("first_data") + sample_end)),
    )
    sheets = sheets.join(last_values(grid), SHEET, "left")
    used = F.filter(F.coalesce("used", F.expr("array()").cast("array<struct<at:int,last:bigint>>")), lambda u: u["last"] >= F.col("first_data"))
    with_values = F.transform(used, lambda u: u["at"])
    titles = F.coalesce(F.try_element_at("levels", F.lit(-1)), F.expr("array()").cast("array<string>"))
    titled = F.filter(F.transform(titles, lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull())
    all_columns = F.array_sort(F.array_union(with_values, titled))
    sampled = F.filter(with_values, lambda i: F.exists("samples", lambda r: has_value(F.get(r["cells"], i))))
    sheets = sheets.withColumn("columns", all_columns).withColumn("titles", titles)
    sheets = sheets.withColumn("combined", F.col("has_header") & (F.size(sampled) == F.size("columns")))

    def name_at(i: Column) -> Column:
        direct = F.exists("levels", lambda level: F.coalesce(F.get(level, i), F.lit("")) != "")
        carried = F.transform(
            "levels", lambda level: F.try_element_at(F.filter(F.slice(level, F.lit(1), i + 1), lambda x: x != ""), F.lit(-1))
        )
        combined = F.array_join(F.array_distinct(F.array_compact(carried)), " ")
        return F.when(direct, combined).otherwise(F.lit(""))

    def title_at(i: Column) -> Column:
        title = F.coalesce(F.get("titles", i), F.lit(""))
        return F.when(title != "", title).otherwise(F.concat(F.lit("__UNNAMED__"), i.cast("string")))

    name = F.transform("columns", lambda i: F.when(F.col("combined"), name_at(i)).otherwise(title_at(i)))
    names = unique_names_column(name, "Coluna ", " (", ")")
    return sheets.select(*SHEET, "header_rows", "first_data", "columns", names.alias("names"), "combined")


def _label(cell: Column) -> Column:
    """Header text on one line; hyphens at a line break join the word."""
    joined = F.regexp_replace(cell, "-(_x000d_)?\n", "")
    return F.when(has_value(cell), strip(F.regexp_replace(F.replace(joined, F.lit("_x000d_"), F.lit(" ")), r"[\s ]+", " "))).otherwise(F.lit(""))


def table_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows of every sheet, cells in the order of the header names.

    Empty rows, repeated header rows and everything after the last row with two filled cells are dropped.
    Headers and rows are written once, since later steps read them several times.
    """
    counts = grid.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("_rows"))
    headed = materialise(counts.join(headers.select(*SHEET, "first_data", "columns", "names", "combined"), SHEET, "left"), "headers")
    joined = attach_counted(grid, headed, SHEET)
    picked = joined.filter(F.col("row_number") >= F.col("first_data")).withColumn(
        "cells", F.transform("columns", lambda i: F.get("cells", i))
    )
    same = F.zip_with("cells", "names", lambda c, n: F.coalesce(F.lower(strip(c)) == F.lower(strip(n)), F.lit(False)))
    is_header = F.col("combined") & (F.size("cells") > 0) & F.forall(same, lambda x: x)
    filled = F.size(F.filter("cells", lambda c: F.coalesce(strip(c) != "", F.lit(False))))
    rows = materialise(picked.filter(~is_header & (filled > 0)).withColumn("filled", filled), "grid")
    enough = F.col("filled") >= F.least(F.lit(2), F.size("names"))
    ends = rows.groupBy(*SHEET).agg(F.max(F.when(enough, F.col("row_number"))).alias("_last"), F.count(F.lit(1)).alias("_kept"))
    kept = attach_counted(rows, ends, SHEET).filter(F.col("row_number") <= F.col("_last"))
    return kept.select(*SHEET, "row_number", "names", "cells")


def staged_rows(rows: DataFrame) -> DataFrame:
    """Staged rows of all sheets: file as import, rows renumbered from 1."""
    numbered = number_rows(rows.withColumnRenamed("row_number", "_grid_row"), SHEET, "_grid_row", [], "row_number")
    return numbered.select(
        F.col("file").alias("import_id"), F.col("sheet").alias("sheet_name"), "row_number",
        F.map_from_arrays("names", "cells").alias("raw_row"), F.lit(None).cast("map<string,string>").alias("normalized_row"),
    )


def largest_sheet(rows: DataFrame) -> DataFrame:
    """The sheet with most cells of every file; of equal ones the first in the file (``sheet_position``, else the name)."""
    place = F.min("sheet_position") if "sheet_position" in rows.columns else F.lit(None).cast("int")
    sizes = rows.groupBy(*SHEET).agg((F.count(F.lit(1)) * F.max(F.size("names"))).alias("cells"), place.alias("place"))
    first = F.min_by("sheet", F.struct(-F.col("cells"), F.coalesce("place", F.lit(0)), "sheet"))
    return sizes.groupBy("file").agg(first.alias("sheet"), F.max("cells").alias("cells"))


def quality_warnings(grid: DataFrame, rows: DataFrame) -> DataFrame:
    """Per sheet: number of sparse columns without title, and the row count its title promises if it differs."""
    cells = rows.select(*SHEET, F.posexplode(F.arrays_zip("names", "cells")).alias("at", "c"))
    is_unnamed = F.lower(F.col("c.names")).rlike("^(coluna |__unnamed__)")
    filled = F.count_if(F.coalesce(strip(F.col("c.cells")) != "", F.lit(False)))
    per_column = cells.filter(is_unnamed).groupBy(*SHEET, "at").agg(filled.alias("filled"), F.count(F.lit(1)).alias("n"))
    sparse = per_column.groupBy(*SHEET).agg(
        F.count_if((F.col("filled") > 0) & (F.col("filled") <= F.col("n") * SPARSE_SHARE)).alias("sparse_columns")
    )
    heights = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows"))
    top = grid.filter(F.col("row_number") <= TITLE_ROWS)
    titles = top.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("row_number", F.filter("cells", has_value).alias("cells")))).alias("t"))
    text = F.regexp_replace(F.array_join(F.flatten(F.transform("t", lambda r: r["cells"])), " "), r"[_\W]+", " ")
    promised = F.regexp_extract(text, r"(?i)\b([0-9]{1,4}) maiores?\b", 1).try_cast("int")
    checked = heights.join(sparse, SHEET, "left").join(titles.select(*SHEET, promised.alias("promised")), SHEET, "left")
    return checked.select(
        *SHEET, F.coalesce("sparse_columns", F.lit(0).cast("long")).alias("sparse_columns"),
        F.when(F.col("promised") != F.col("rows"), F.col("promised")).alias("promised_rows"), "rows",
    )
