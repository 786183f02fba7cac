"""Wide to long, wide column to prepared rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civigrade.functions.naming import CODE_COLUMN, IDENTITY_COLUMNS
from civigrade.functions.periods import title_period
from civigrade.functions.text import cell_text, drop_fields, merged_field, put_fields
from civigrade.functions.values import number_text, parse_number, parse_plain_or_regional, parse_wide_number
from civigrade.operators.geography import resolve_codes
from civigrade.operators.joins import rows_before
from civigrade.session import materialise

PREPARED_FIELDS = ["reference_year", "reference_period", "value", "source_measure"]


@dataclass(frozen=True)
class PeriodColumn:
    """A column that holds one period of a measure."""

    field: str
    year: int
    month: int | None = None

    @property
    def label(self) -> str:
        return f"{self.year}-{self.month:02d}-01" if self.month else str(self.year)


def _cell(name: str) -> Column:
    return merged_field(F.col("raw_row"), F.col("normalized_row"), name)


def identity_fields(columns: list[str], municipality_field: str) -> list[str]:
    """Fields kept from the original row: the chosen municipality field, then known names and code columns."""
    known = [c for c in columns if c in IDENTITY_COLUMNS or re.search(CODE_COLUMN, c)]
    return list(dict.fromkeys([municipality_field, *known]))


def target_sheet(measure_label: str, longest_label: int | None = None) -> str:
    """What is added to the name of a sheet for the long form of a measure; a label above ``longest_label`` characters is cut."""
    label = " ".join(measure_label.split())[:longest_label] or "medida"
    return f" · {label} por período"


def period_columns(spark: SparkSession, names: list[str]) -> list[PeriodColumn]:
    """Period columns from their titles; titles without a period are refused. One row of expressions, no job."""
    if not names:
        return []
    periods = spark.range(1).select(F.array(*[title_period(F.lit(name)) for name in names]).alias("p")).first()["p"]
    missing = [name for name, period in zip(names, periods) if period is None]
    if missing:
        raise ValueError(f"no period in the titles {', '.join(missing)}")
    return [PeriodColumn(name, period["year"], period["month"]) for name, period in zip(names, periods)]


def _filled_cells(columns: list[PeriodColumn]) -> Column:
    """The period columns of a row that have a text, in order."""
    cells = F.array(
        *[
            F.struct(
                F.lit(position).alias("period_position"), F.lit(c.field).alias("field"), F.lit(c.year).alias("year"),
                F.lit(c.month).cast("int").alias("month"), F.lit(c.label).alias("label"), cell_text(_cell(c.field)).alias("text"),
                F.try_element_at("raw_row", F.lit(c.field)).alias("raw"),
            )
            for position, c in enumerate(columns)
        ]
    )
    return F.filter(cells, lambda cell: cell["text"] != "")


def expand_periods(
    staged: DataFrame, columns: list[PeriodColumn], municipality_field: str, municipalities: DataFrame,
    identity: list[str], measure_label: str, longest_label: int | None = None,
) -> DataFrame:
    """Derived sheet with one row per source row and period; cells that do not read as numbers stay without value.

    Rows are numbered before they are unfolded: each source row knows how many cells the rows before it have.
    """
    kept = F.map_filter("raw_row", lambda key, _: key.isin(*identity))
    rows = staged.select(
        "import_id", "sheet_name", "row_number", kept.alias("kept"), cell_text(_cell(municipality_field)).alias("municipality_text"),
        _filled_cells(columns).alias("cells"),
    ).filter(F.size("cells") > 0)
    # Counting and placing both read the cells, so these are picked once.
    rows = materialise(rows, "period-cells")
    placed = rows_before(rows, ["import_id", "sheet_name"], "row_number", [], F.size("cells"), "cells_before")
    resolved = resolve_codes(placed, F.col("municipality_text"), municipalities)
    unfolded = resolved.select("*", F.posexplode("cells").alias("cell_position", "cell")).select("*", "cell.*").drop("cells", "cell")
    value = parse_wide_number(F.col("text"))
    raw = put_fields(
        F.col("kept"),
        {"linha_original": F.col("row_number"), "coluna_original": F.col("field"), "competencia": F.col("label"), "valor": F.col("raw")},
    )
    prepared = put_fields(
        F.lit(None).cast("map<string,string>"),
        {
            "municipality_ibge_code": F.col("municipality_code"),
            "reference_year": F.col("year"),
            "reference_period": F.when(F.col("month").isNotNull(), F.col("label")),
            "value": number_text(value),
            "source_measure": F.col("field"),
        },
        drop_nulls=True,
    )
    return unfolded.select(
        "import_id", F.concat("sheet_name", F.lit(target_sheet(measure_label, longest_label))).alias("sheet_name"),
        F.col("row_number").alias("source_row_number"), "period_position", "municipality_code", F.col("year").alias("reference_year"),
        F.col("month").alias("reference_month"), value.alias("value"), raw.alias("raw_row"), prepared.alias("normalized_row"),
        (F.col("cells_before") + F.col("cell_position") + 1).alias("row_number"),
    )


def expansion_counts(staged: DataFrame, expanded: DataFrame, columns: int) -> DataFrame:
    """Rows created, empty cells and rows without a municipality, per import."""
    sources = staged.groupBy("import_id").agg((F.count(F.lit(1)) * columns).alias("cells"))
    created = expanded.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("created_rows"), F.count_if(F.col("municipality_code").isNull()).alias("unresolved_rows")
    )
    none = F.lit(0).cast("long")
    return sources.join(created, "import_id", "left").select(
        "import_id",
        F.coalesce("created_rows", none).alias("created_rows"),
        (F.col("cells") - F.coalesce("created_rows", none)).alias("empty_cells"),
        F.coalesce("unresolved_rows", none).alias("unresolved_rows"),
    )


def prepare_wide_column(staged: DataFrame, column: PeriodColumn, municipality_field: str, reset: bool = False) -> DataFrame:
    """Prepare every row from one period column; ``is_prepared`` tells whether code and value were readable.

    Rows that cannot be read lose earlier prepared fields. With ``reset`` every row loses all of them first, and codes and values are
    those of the source row as it is, in the plain or regional notation only.
    """
    code = cell_text(_cell(municipality_field))
    value = parse_number(_cell(column.field))
    if reset:
        code = F.try_element_at("raw_row", F.lit(municipality_field))
        value = parse_plain_or_regional(F.try_element_at("raw_row", F.lit(column.field)))
        base = F.expr("map()").cast("map<string,string>")
    else:
        base = drop_fields(F.coalesce("normalized_row", F.expr("map()").cast("map<string,string>")), PREPARED_FIELDS)
    fields = {
        "municipality_ibge_code": code,
        "reference_year": F.lit(str(column.year)),
        "value": number_text(value),
        "source_measure": F.lit(column.field),
    }
    if column.month:
        fields["reference_period"] = F.lit(column.label)
    is_prepared = F.coalesce(code.rlike("^[0-9]{7}$"), F.lit(False)) & value.isNotNull()
    return (
        staged.withColumn("is_prepared", is_prepared)
        .withColumn("value", F.when(is_prepared, value))
        .withColumn("normalized_row", F.when(is_prepared, put_fields(base, fields)).otherwise(base))
    )


def prepared_counts(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("import_id").agg(
        F.count_if("is_prepared").alias("transformed_rows"), F.count_if(~F.col("is_prepared")).alias("skipped_rows")
    )
