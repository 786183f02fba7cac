"""Column profiles of staged sheets, and what the columns suggest.

A profile has one row per sheet and column: ``import_id, sheet_name, position, column_name, dtype,
rows, null_count, sample``. Everything after it works on names as data, for any number of sheets.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civigrade.functions import naming
from civigrade.functions.text import json_cell, strip, title_key
from civigrade.functions.values import COLUMN_NUMBER
from civigrade.operators.joins import first_per_key

SHEET = ["import_id", "sheet_name"]
SAMPLE_ROWS = 20
NUMERIC_SHARE = 0.6
PERIOD_SHARE, PERIOD_VALUES = 0.8, 2

# Measures of employment files -> indicator code, name, definition.
EMPLOYMENT_MEASURES = (
    ("saldos", "caged_saldo_empregos", "Saldo de empregos formais", "Diferença entre admissões e desligamentos formais no período."),
    ("admissoes", "caged_admissoes", "Admissões formais", "Quantidade de admissões formais registradas no período."),
    ("desligamentos", "caged_desligamentos", "Desligamentos formais", "Quantidade de desligamentos formais registrados no período."),
    ("estoque", "caged_estoque_empregos", "Estoque de empregos formais", "Quantidade de vínculos formais de emprego no período."),
)
POWER_INDICATOR = ("potencia_geracao_instalada", "Potência de geração instalada")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename the columns of a table to canonical, unique names; code columns become text without fraction."""
    names = naming.canonical_names(df.sparkSession, df.columns)
    renamed = df.toDF(*names)
    codes = [c for c in names if _is_code(c)]
    for name in codes:
        text = F.col(name).cast("string")
        cleaned = F.when(text.rlike(r"^[0-9]{6,7}\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
        renamed = renamed.withColumn(name, cleaned)
    return renamed


def _is_code(name: str) -> bool:
    return re.search(naming.CODE_COLUMN, name) is not None


def holds_regional_decimals(column: Column) -> Column:
    """Aggregate: at least 60 % of the filled cells are numbers, one of them has a separator, and a double holds them all."""
    cell = strip(column)
    filled = F.coalesce(~cell.isin("", "-"), F.lit(False))
    number = filled & cell.rlike(COLUMN_NUMBER)
    return (
        (F.count_if(number) >= F.count_if(filled) * NUMERIC_SHARE)
        & (F.count_if(filled) > 0)
        & F.coalesce(F.bool_or(number & cell.rlike("[.,]")), F.lit(False))
        & ~F.coalesce(F.bool_or(cell.rlike("^-?[0-9]{16,}$")), F.lit(False))
    )


def decimal_columns(df: DataFrame) -> list[str]:
    """Text columns that hold regional decimals. One aggregation over all text columns; only their names come back."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    flags = df.agg(*[holds_regional_decimals(F.col(f"`{name}`")).alias(name) for name in texts]).first()
    return [name for name in texts if flags[name]]


def regional_decimal(cell: Column) -> Column:
    """Double of a cell of a decimal column; cells that are no number become null."""
    text = strip(cell)
    plain = F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text)
    return F.when(~text.isin("", "-"), plain.try_cast("double"))


def normalise_decimals(df: DataFrame) -> DataFrame:
    names = decimal_columns(df)
    return df.withColumns({name: regional_decimal(F.col(f"`{name}`")) for name in names}) if names else df


def profile_dataframe(df: DataFrame, sheet_name: str = "Dados", import_id: str = "") -> DataFrame:
    """Profile of one typed table: a single aggregation, one row per column."""
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("null_count"),
        )
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.agg(F.array(*entries).alias("e")).select(
        F.lit(import_id).alias("import_id"), F.lit(sheet_name).alias("sheet_name"), F.inline("e")
    )


def as_staged_cells(df: DataFrame) -> Column:
    """A table's row as the map a staged row keeps."""
    parts = [p for f in df.schema.fields for p in (F.lit(f.name), json_cell(F.col(f"`{f.name}`"), f.dataType))]
    return F.create_map(*parts)


def profile_staged(staged: DataFrame) -> DataFrame:
    """Profile of all staged sheets in one job. Types are read off the texts; samples hold the first rows."""
    cells = staged.select(*SHEET, "row_number", F.posexplode("raw_row").alias("at", "column_name", "text"))
    text = F.col("text")
    is_number = text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    filled = text.isNotNull()
    per_column = cells.groupBy(*SHEET, "column_name").agg(
        F.min(F.struct("row_number", "at")).alias("first_seen"),
        F.count(F.lit(1)).alias("present"),
        F.count_if(~filled).alias("empty"),
        F.coalesce(F.bool_and(F.when(filled, text.rlike("^-?[0-9]{1,18}$"))), F.lit(False)).alias("all_whole"),
        F.coalesce(F.bool_and(F.when(filled, is_number)), F.lit(False)).alias("all_number"),
        F.coalesce(F.bool_and(F.when(filled, text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"))), F.lit(False)).alias("all_date"),
    )
    heights = staged.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows"))
    dtype = F.when(F.col("all_whole"), "bigint").when(F.col("all_number"), "double").when(F.col("all_date"), "date").otherwise("string")
    first_rows = first_per_key(staged.select(*SHEET, "row_number", "raw_row"), SHEET, F.col("row_number"), rows=SAMPLE_ROWS)
    samples = (
        first_rows.select(*SHEET, "row_number", F.explode("raw_row").alias("column_name", "text"))
        .groupBy(*SHEET, "column_name")
        .agg(F.sort_array(F.collect_list(F.struct("row_number", "text"))).alias("s"))
        .select(*SHEET, "column_name", F.transform("s", lambda x: x["text"]).alias("sample"))
    )
    profile = per_column.join(heights, SHEET).join(samples, [*SHEET, "column_name"], "left")
    return profile.select(
        *SHEET, "column_name", "first_seen", dtype.alias("dtype"), "rows",
        (F.col("rows") - F.col("present") + F.col("empty")).alias("null_count"), "sample",
    )


def with_positions(profile: DataFrame) -> DataFrame:
    """Column positions of a staged profile: order in which a sheet first shows its columns."""
    order = Window.partitionBy(*SHEET).orderBy("first_seen")  # the columns of one sheet
    return profile.withColumn("position", F.row_number().over(order)).drop("first_seen")


def canonical_names(profile: DataFrame) -> DataFrame:
    """Canonical unique names of all sheets' columns, as data. Only the columns of one sheet meet in a group."""
    plain = naming.column_name(F.col("column_name"))
    named = profile.withColumn("_plain", F.when(F.startswith(plain, F.lit("__unnamed__")), F.lit("")).otherwise(plain))
    columns = named.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("position", "_plain"))).alias("_columns"))
    unique = naming.unique_names_column(F.transform("_columns", lambda c: c["_plain"]))
    pairs = F.arrays_zip(F.transform("_columns", lambda c: c["position"]).alias("position"), unique.alias("canonical_name"))
    numbered = columns.select(*SHEET, F.inline(pairs))
    return profile.join(numbered, [*SHEET, "position"])


def classify_columns(profile: DataFrame) -> DataFrame:
    """Flags per column: code, municipality, month and year titles, identity."""
    name = F.col("column_name")
    return profile.withColumns(
        {
            "is_code": naming.is_code_column(name),
            "is_municipality": naming.is_municipality_column(name),
            "is_monthly": naming.is_monthly_column(name),
            "is_annual": naming.is_annual_column(name),
            "is_identity": name.isin(*naming.IDENTITY_COLUMNS) | naming.is_code_column(name),
        }
    )


def suggest_mapping(profile: DataFrame) -> DataFrame:
    """Per sheet: first code and name column, last year and value column."""
    name, position = F.col("column_name"), F.col("position")
    first = lambda flag: F.min_by(F.when(flag, name), F.when(flag, position))
    last = lambda flag: F.max_by(F.when(flag, name), F.when(flag, position))
    return profile.groupBy(*SHEET).agg(
        first(naming.is_code_column(name)).alias("municipality_code"),
        first(naming.is_place_name_column(name)).alias("municipality_name"),
        last(name.isin(*naming.YEAR_COLUMNS)).alias("reference_year"),
        last(name.isin(*naming.VALUE_COLUMNS)).alias("value"),
    )


def municipality_columns(profile: DataFrame) -> DataFrame:
    """Columns to choose the municipality from: ``choice`` numbers them, recognised ones first, and ``is_suggested`` marks one per sheet.

    Suggested is the name column that the sheet suggests, else its code column, else the first one, if it is recognised as municipality.
    """
    name = F.col("column_name")
    known = naming.is_municipality_column(name)
    flagged = profile.select(*SHEET, "position", "column_name", known.alias("is_recognised"))
    suggested = suggest_mapping(profile).select(*SHEET, "municipality_name", "municipality_code")
    joined = flagged.join(suggested, SHEET)
    place = F.when(name == F.col("municipality_name"), 0).when(name == F.col("municipality_code"), 1).otherwise(2)
    best = F.when(F.col("is_recognised"), F.struct(place.alias("p"), "position"))
    of_sheet = Window.partitionBy(*SHEET)  # the columns of one sheet
    order = of_sheet.orderBy(F.col("is_recognised").desc(), "position")
    chosen = joined.withColumns({"choice": F.row_number().over(order), "_best": F.min(best).over(of_sheet)})
    return chosen.select(*SHEET, "column_name", "choice", "is_recognised", F.coalesce(best == F.col("_best"), F.lit(False)).alias("is_suggested"))


def recommend_indicators(profile: DataFrame) -> DataFrame:
    """Indicators the columns of each sheet can feed.

    Employment files give one per measure, read from its last monthly column or else its last column;
    other sheets give installed power from the first ``potencia…kw`` column.
    """
    plain = title_key(naming.column_name(F.col("column_name")))
    named = profile.select(*SHEET, "position", "column_name", plain.alias("plain"))
    contains = lambda token: F.contains(F.col("plain"), F.lit(token))
    any_measure = reduce(Column.__or__, [contains(token) for token, *_ in EMPLOYMENT_MEASURES])
    entries = []
    for token, code, label, definition in EMPLOYMENT_MEASURES:
        monthly = contains(token) & naming.is_monthly_measure(F.col("column_name"), token)
        best = F.max(F.when(contains(token), F.struct(monthly.cast("int").alias("m"), F.col("position").alias("p"), F.col("column_name").alias("c"))))
        entries.append(
            F.struct(
                F.lit(code).alias("code"), F.lit(label).alias("name"), F.lit("trabalho").alias("dimension"),
                F.lit(definition).alias("definition"), F.lit("pessoas").alias("unit"), F.lit("mensal").alias("expected_frequency"),
                best["c"].alias("value_field"),
            )
        )
    is_power = contains("potencia") & F.endswith("plain", F.lit("kw"))
    power = F.struct(
        F.lit(POWER_INDICATOR[0]).alias("code"), F.lit(POWER_INDICATOR[1]).alias("name"), F.lit("energia").alias("dimension"),
        F.lit("Potência declarada de empreendimentos de geração de energia.").alias("definition"), F.lit("kW").alias("unit"),
        F.lit("anual").alias("expected_frequency"),
        F.min_by(F.when(is_power, F.col("column_name")), F.when(is_power, F.col("position"))).alias("value_field"),
    )
    is_employment = F.bool_or(contains("codigo")) & F.bool_or(contains("municipio")) & F.bool_or(any_measure)
    grouped = named.groupBy(*SHEET).agg(
        F.when(is_employment, F.array(*entries)).otherwise(F.array(power)).alias("recommended")
    )
    return grouped.select(*SHEET, F.inline("recommended")).filter(F.col("value_field").isNotNull())


def suggest_period(profile: DataFrame) -> DataFrame:
    """Per sheet how periods are told: year and month columns, a year column, a date column, or none.

    A column without a telling name counts when 80 % of its first values, and two at least, are a month and year.
    """
    name = F.col("column_name")
    suggested = F.max_by(F.when(name.isin(*naming.YEAR_COLUMNS), name), F.when(name.isin(*naming.YEAR_COLUMNS), F.col("position")))
    first = lambda flag: F.min_by(F.when(flag, name), F.when(flag, F.col("position")))
    hits = F.size(F.filter("sample", naming.is_period_value))
    by_value = naming.may_hold_periods(name) & (hits >= PERIOD_VALUES) & (hits >= F.size("sample") * PERIOD_SHARE)
    found = profile.groupBy(*SHEET).agg(
        F.coalesce(suggested, first(naming.is_year_name(name))).alias("year_field"),
        first(naming.is_month_name(name)).alias("month_field"),
        first(naming.is_date_name(name)).alias("date_field"),
        first(F.coalesce(by_value, F.lit(False))).alias("sampled_field"),
    )
    year, month = F.col("year_field").isNotNull(), F.col("month_field").isNotNull()
    date = F.coalesce("date_field", "sampled_field")
    mode = F.when(year & month, "month_year_columns").when(year, "year_column").when(date.isNotNull(), "date_column").otherwise("fixed")
    monthly = (year & month) | (~year & date.isNotNull())
    return found.select(
        *SHEET, mode.alias("mode"), F.when(monthly, F.lit("month")).otherwise(F.lit("year")).alias("granularity"), "year_field",
        F.when(year & month, F.col("month_field")).alias("month_field"), F.when(~year, date).alias("date_field"),
    )


def period_measure_groups(profile: DataFrame) -> DataFrame:
    """Columns of one measure over two or more periods, in order of time (the columns of one sheet)."""
    parsed = profile.withColumn("p", naming.period_measure(F.col("column_name"))).filter(F.col("p").isNotNull())
    granularity = F.when(F.col("p.month").isNotNull(), F.lit("month")).otherwise(F.lit("year"))
    at = F.struct(F.col("p.year").alias("year"), F.col("p.month").alias("month"), "position", "column_name")
    grouped = (
        parsed.groupBy(*SHEET, granularity.alias("granularity"), F.col("p.measure").alias("measure"))
        .agg(F.sort_array(F.collect_list(at)).alias("columns"))
        .filter(F.size("columns") >= 2)
    )
    first, last = F.col("columns")[0], F.element_at("columns", -1)

    def label(point: Column) -> Column:
        month = F.concat(F.lpad(point["month"].cast("string"), 2, "0"), F.lit("/"), point["year"].cast("string"))
        return F.when(point["month"].isNotNull(), month).otherwise(point["year"].cast("string"))

    measure = F.replace("measure", F.lit("_"), F.lit(" "))
    return grouped.select(
        *SHEET, "granularity", "measure", F.when(F.col("measure") == "", F.lit("valor")).otherwise(measure).alias("label"),
        F.transform("columns", lambda c: c["column_name"]).alias("fields"),
        label(first).alias("first_period"), label(last).alias("last_period"),
    )


def expanded_sheets(profile: DataFrame) -> DataFrame:
    """Whether each sheet came from expanding periods, and its granularity."""
    name = F.col("column_name")
    has = lambda column: F.bool_or(name == column)
    dated = F.exists("sample", lambda v: v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    return profile.groupBy(*SHEET).agg(
        (has("competencia") & has("coluna_original") & has("linha_original")).alias("is_expanded"),
        F.when(F.bool_or((name == "competencia") & F.coalesce(dated, F.lit(False))), F.lit("month")).otherwise(F.lit("year")).alias("granularity"),
    )
