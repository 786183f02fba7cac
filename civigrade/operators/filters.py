"""Row, serving-table and catalog filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.periods import period_bound
from civigrade.functions.text import cell_text, dimension_prefix, merged_field, words_key
from civigrade.functions.values import filter_key, short_number

OPERATORS = ("eq", "neq", "in", "gte", "lte", "contains")


@dataclass(frozen=True)
class RowFilter:
    field: str
    operator: str = "eq"
    value: str = ""

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}")


def predicate(cell: Column, row_filter: RowFilter) -> Column:
    """Whether a cell passes one filter. A missing cell is the empty text; texts compare without case."""
    text = cell_text(cell)
    folded = F.lower(text)
    wanted = row_filter.value.strip()
    if row_filter.operator == "eq":
        return folded == wanted.lower()
    if row_filter.operator == "neq":
        return folded != wanted.lower()
    if row_filter.operator == "contains":
        return F.contains(folded, F.lit(wanted.lower()))
    if row_filter.operator == "in":
        parts = [part.strip().lower() for part in wanted.split(";") if part.strip()]
        return folded.isin(*parts) if parts else F.lit(False)
    compared = lambda left, right: left >= right if row_filter.operator == "gte" else left <= right
    # Only numbers that are long, signed by a plus or written with an exponent need the key.
    short, bound = short_number(text), short_number(F.lit(wanted))
    by_key = compared(filter_key(text), filter_key(F.lit(wanted)))
    return F.coalesce(F.when(short.isNotNull() & bound.isNotNull(), compared(short, bound)).otherwise(by_key), F.lit(False))


def apply_filters(
    df: DataFrame, filters: list[RowFilter], keep_latest_of: str | None = None, cell: Callable[[str], Column] = F.col
) -> DataFrame:
    """Rows that pass all filters; with ``keep_latest_of`` then only those with its highest value.

    Highest means by number; where no value is a number, the last text in order.
    """
    kept = df.filter(reduce(Column.__and__, [predicate(cell(f.field), f) for f in filters], F.lit(True)))
    if not keep_latest_of:
        return kept
    text = cell_text(cell(keep_latest_of))
    short, number = short_number(text), filter_key(text)
    tops = kept.agg(F.max(short).alias("short"), F.max(F.when(short.isNull(), number)).alias("number"), F.max(F.when(text != "", text)).alias("text"))
    # The highest short number takes part by its key, and keeps its decimal if no other number is higher.
    key = filter_key(F.col("short").cast("string"))
    tops = tops.select(F.greatest(key, F.col("number")).alias("number"), F.when(key >= F.coalesce("number", key), F.col("short")).alias("short"), "text")
    best = tops.select(F.struct("number", "short", "text")).scalar()
    top_number, top_short, top_text = best["number"], best["short"], best["text"]
    is_highest = F.when(short.isNotNull(), short == top_short).otherwise(number == top_number)
    is_latest = F.when(top_number.isNotNull(), is_highest).when(top_text.isNotNull(), text == top_text).otherwise(True)
    return kept.filter(F.coalesce(is_latest, F.lit(False)))


def filter_staged(staged: DataFrame, filters: list[RowFilter], keep_latest_of: str | None = None) -> DataFrame:
    """Staged rows whose merged cells pass the filters."""
    if not filters and not keep_latest_of:
        raise ValueError("give at least one filter or the column of the latest period")
    return apply_filters(
        staged, filters, keep_latest_of, lambda name: merged_field(F.col("raw_row"), F.col("normalized_row"), name)
    )


def filter_counts(staged: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows, kept rows and removed rows per import and sheet that was filtered."""
    keys = ["import_id", "sheet_name"]
    left = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept_rows"))
    total = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows")).join(left, keys, "left")
    present = F.coalesce("kept_rows", F.lit(0))
    return total.select(*keys, "total_rows", present.alias("kept_rows"), (F.col("total_rows") - present).alias("removed_rows"))


def serving_rows(
    serving: DataFrame,
    indicator_code: str | None = None,
    dataset_id: str | None = None,
    municipality_code: str | None = None,
    dimension: str | None = None,
    period_from: str | None = None,
    period_to: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Rows of the serving table; all given conditions must hold."""
    conditions = []
    if indicator_code:
        conditions.append(F.col("indicator_code") == indicator_code)
    if dataset_id:
        conditions.append(F.col("dataset_id") == dataset_id)
    if municipality_code and municipality_code.strip():
        if not (municipality_code.strip().isdigit() and len(municipality_code.strip()) == 7):
            raise ValueError("a municipality code has seven digits")
        conditions.append(F.col("municipality_ibge_code") == municipality_code.strip())
    if dimension and dimension.strip():
        conditions.append(F.startswith("indicator_code", dimension_prefix(F.lit(dimension))))
    for text, upper in ((period_from, False), (period_to, True)):
        if text and text.strip():
            bound = period_bound(F.lit(text), upper)
            conditions.append(F.col("reference_period") <= bound if upper else F.col("reference_period") >= bound)
    term = "".join(" " if c in ',()*"\\' else c for c in search or "").strip()
    if term:
        pattern = f"%{term}%"
        conditions.append(F.col("indicator_code").ilike(pattern) | F.col("indicator_name").ilike(pattern))
    return serving.filter(reduce(Column.__and__, conditions, F.lit(True)))


def check_period_range(period_from: str | None, period_to: str | None, spark) -> None:
    """Raise when a bound is no date or the range is inverted."""
    start = period_bound(F.lit(period_from), False) if period_from else F.lit(None).cast("date")
    end = period_bound(F.lit(period_to), True) if period_to else F.lit(None).cast("date")
    row = spark.range(1).select(start.alias("start"), end.alias("end")).first()
    if (period_from and row["start"] is None) or (period_to and row["end"] is None):
        raise ValueError("give periods as YYYY, YYYY-MM or YYYY-MM-DD")
    if row["start"] and row["end"] and row["start"] > row["end"]:
        raise ValueError("the first period must not be after the last one")


def search_catalog_rows(catalog: DataFrame, query: str, fields: tuple[str, ...] = ("code", "name", "dimension", "unit")) -> DataFrame:
    """Catalog rows that contain every word of the query, with ``match_rank``: 0 exact code, 1 code, 2 name prefix, 3 rest."""
    terms = words_key(F.lit(query))
    text = words_key(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    words = F.filter(F.split(terms, " "), lambda w: w != "")
    first = F.get(words, F.lit(0))
    code, name = words_key(F.col(fields[0])), words_key(F.col(fields[1]))
    rank = (
        F.when(F.size(words) == 0, 0)
        .when(code == first, 0)
        .when(F.startswith(code, first), 1)
        .when(F.startswith(name, first), 2)
        .otherwise(3)
    )
    return catalog.filter(F.forall(words, lambda w: F.contains(text, w))).withColumn("match_rank", rank)


def collection_rows(
    items: DataFrame, access: str | None = None, search: str = "", covered: DataFrame | None = None
) -> DataFrame:
    """Source-catalog rows by access and text; with ``covered`` (short codes that have data) only those without data."""
    rows = items.filter(F.col("access") == access) if access else items
    if covered is not None:
        rows = rows.withColumn("short_code", F.upper("code")).join(covered.select("short_code"), "short_code", "left_anti").drop("short_code")
    term = search.strip().lower()
    if term:
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "code", "name", "source", "factor")), F.lit(term)))
    return rows
