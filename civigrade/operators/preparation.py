"""From staged text rows to typed, prepared rows: code, period, indicator values."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.periods import PeriodSelection, month_start_text, row_period
from civigrade.functions.text import cell_text, merged_field, put_fields
from civigrade.functions.values import STORED, clamp, number_text, parse_number, parse_number_us_first, ratio
from civigrade.operators.geography import resolve_codes
from civigrade.operators.joins import few_per_key, first_per_key, lookup

APPROVAL_CODE_FIELD = "approval_municipality_ibge_code"
PROBLEM_SAMPLES = 5
PREVIEW_EXAMPLES = 10


def _cell(name: str) -> Column:
    return merged_field(F.col("raw_row"), F.col("normalized_row"), name)


@dataclass(frozen=True)
class IndicatorMapping:
    """How one indicator is read: a column, a ratio of two columns, or a ratio to the population."""

    indicator_code: str
    unit: str
    calculation: str = "direct"
    value_field: str | None = None
    numerator_field: str | None = None
    denominator_field: str | None = None
    multiplier: float = 1.0
    value_min: float | None = None
    value_max: float | None = None

    def __post_init__(self) -> None:
        needed = {
            "direct": (self.value_field,),
            "ratio": (self.numerator_field, self.denominator_field),
            "ratio_population": (self.numerator_field,),
        }
        if self.calculation not in needed:
            raise ValueError(f"unknown calculation {self.calculation}")
        if not all(needed[self.calculation]):
            raise ValueError(f"{self.indicator_code}: choose the columns of the calculation")
        if self.calculation == "ratio" and self.numerator_field == self.denominator_field:
            raise ValueError(f"{self.indicator_code}: numerator and denominator must differ")
        if not 0 < self.multiplier <= 1_000_000:
            raise ValueError(f"{self.indicator_code}: the multiplier must be above 0 and at most 1,000,000")
        if not self.unit.strip():
            raise ValueError(f"{self.indicator_code}: give a unit")
        if self.value_min is not None and self.value_max is not None and not self.value_min < self.value_max:
            raise ValueError(f"{self.indicator_code}: the lower limit must be below the upper one")

    @property
    def prepared_field(self) -> str:
        return f"value__{self.indicator_code}"

    def calculation_json(self) -> str:
        if self.calculation == "direct":
            return json.dumps({"type": "direct", "value_field": self.value_field})
        parts = {"type": self.calculation, "numerator_field": self.numerator_field}
        if self.calculation == "ratio":
            parts["denominator_field"] = self.denominator_field
        return json.dumps({**parts, "multiplier": self.multiplier})

    @property
    def fields(self) -> list[str]:
        """Cells the calculation reads."""
        if self.calculation == "direct":
            return [self.value_field]
        return [self.numerator_field] + ([self.denominator_field] if self.calculation == "ratio" else [])

    def value(self, number: Callable[[str], Column]) -> Column:
        """Calculated value; ``number`` gives the parsed number of a cell."""
        if self.calculation == "direct":
            result = number(self.value_field)
        else:
            denominator = number(self.denominator_field) if self.calculation == "ratio" else F.col("inhabitants")
            result = ratio(number(self.numerator_field), denominator, self.multiplier).try_cast(STORED)
        if self.value_min is None and self.value_max is None:
            return result
        return clamp(result, self.value_min, self.value_max).try_cast(STORED)

    def measure_text(self, text: Callable[[str], Column]) -> Column:
        """What the value came from, for problem samples."""
        if self.calculation == "direct":
            return text(self.value_field)
        numerator = text(self.numerator_field)
        if self.calculation == "ratio":
            return F.concat(numerator, F.lit(" / "), text(self.denominator_field))
        people = F.coalesce(F.col("inhabitants").cast("string"), F.lit("sem dado"))
        year = F.coalesce(F.col("population_year").cast("string"), F.lit("?"))
        return F.concat(numerator, F.lit(" / população "), year, F.lit(": "), people)


def check_mappings(mappings: list[IndicatorMapping], most: int | None = None) -> None:
    """Refuse an empty or repeated choice, and one of more than ``most`` indicators where a limit is wanted."""
    if not mappings or (most is not None and len(mappings) > most):
        raise ValueError("choose at least one indicator" if not mappings else f"choose at most {most} indicators")
    if len({m.indicator_code for m in mappings}) != len(mappings):
        raise ValueError("choose each indicator only once")


def mapping_problems(mappings: list[IndicatorMapping], indicators: DataFrame) -> DataFrame:
    """Why mappings cannot be approved: their indicator (``indicator_code, active``) is unknown or not active. No rows when all can."""
    spark = indicators.sparkSession
    wanted = spark.createDataFrame([(m.indicator_code,) for m in mappings], "indicator_code string")
    known = indicators.groupBy("indicator_code").agg(F.bool_or(F.coalesce("active", F.lit(False))).alias("_active"))
    problem = F.when(F.col("_active").isNull(), F.lit("unknown indicator")).when(~F.col("_active"), F.lit("inactive indicator"))
    return wanted.join(known, "indicator_code", "left").select("indicator_code", problem.alias("problem")).filter("problem IS NOT NULL")


def prepare_places_and_periods(
    staged: DataFrame, selection: PeriodSelection, municipality_field: str, municipalities: DataFrame
) -> DataFrame:
    """Add ``municipality_code``, ``period`` and the texts that could not be read (null where all is well).

    Cells are read before the join: where the catalog is too large to broadcast, what was read of a row moves, not the row.
    """
    period, original = row_period(_cell, selection)
    rows = staged.withColumns({"period": period, "_place": cell_text(_cell(municipality_field))})
    rows = rows.withColumn("period_problem", F.when(F.col("period").isNull(), original))
    resolved = resolve_codes(rows, F.col("_place"), municipalities)
    return resolved.withColumn("municipality_problem", F.when(F.col("municipality_code").isNull(), F.col("_place"))).drop("_place")


def prepare_single(
    staged: DataFrame, selection: PeriodSelection, value_field: str, municipality_field: str, municipalities: DataFrame
) -> DataFrame:
    """Rows of one indicator: code, period and value, with the text of each part that could not be read."""
    rows = staged.withColumn("_text", cell_text(_cell(value_field)))
    rows = prepare_places_and_periods(rows, selection, municipality_field, municipalities)
    rows = rows.withColumn("value", parse_number(F.col("_text")))
    return rows.withColumn("value_problem", F.when(F.col("value").isNull() & (F.col("_text") != ""), F.col("_text"))).drop("_text")


def problem_rows(prepared: DataFrame) -> DataFrame:
    """Problems of :func:`prepare_single`, one row each: kind and original text."""
    kinds = [
        F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_problem").alias("text"))
        for kind in ("municipality", "period", "value")
    ]
    exploded = prepared.select("import_id", "sheet_name", "row_number", F.explode(F.array(*kinds)).alias("p"))
    return exploded.filter(F.col("p.text").isNotNull()).select("import_id", "sheet_name", "row_number", "p.kind", "p.text")


def prepare_batch(
    staged: DataFrame,
    selection: PeriodSelection,
    mappings: list[IndicatorMapping],
    municipality_field: str,
    municipalities: DataFrame,
    population: DataFrame | None = None,
) -> DataFrame:
    """One row per staged row and indicator, all indicators in one pass.

    ``population`` (``year, ibge_code, inhabitants``) is needed for ratios to the population.
    """
    check_mappings(mappings)
    rows = prepare_places_and_periods(_with_texts(staged, mappings), selection, municipality_field, municipalities)
    if any(m.calculation == "ratio_population" for m in mappings):
        if population is None:
            raise ValueError("a ratio to the population needs the population table")
        people = lookup(
            population.select(
                F.col("year").alias("population_year"), F.col("ibge_code").alias("municipality_code"), "inhabitants"
            )
        )
        rows = rows.withColumn("population_year", F.col("period")["year"])
        rows = rows.join(people, ["population_year", "municipality_code"], "left")
    rows, text, number = _with_numbers(rows, mappings)
    values = [
        F.struct(
            F.lit(m.indicator_code).alias("indicator_code"),
            F.lit(m.unit.strip()).alias("unit"),
            m.value(number).alias("value"),
            m.measure_text(text).alias("source_measure"),
            F.lit(m.calculation_json()).alias("calculation"),
        )
        for m in mappings
    ]
    return rows.select(
        "import_id", "sheet_name", "row_number", "municipality_code", "period", "municipality_problem", "period_problem",
        F.inline(F.array(*values)),
    )


def _cell_numbers(mappings: list[IndicatorMapping]) -> dict[str, int]:
    """Number of every cell the mappings read."""
    return {name: i for i, name in enumerate(dict.fromkeys(f for m in mappings for f in m.fields))}


def _with_texts(rows: DataFrame, mappings: list[IndicatorMapping]) -> DataFrame:
    """Rows with the text of every cell the mappings read."""
    return rows.withColumns({f"_text_{i}": cell_text(_cell(name)) for name, i in _cell_numbers(mappings).items()})


def _with_numbers(rows: DataFrame, mappings: list[IndicatorMapping]):
    """Rows of :func:`_with_texts` with the number of every cell, each parsed once, and how to get texts and numbers."""
    place = _cell_numbers(mappings)
    rows = rows.withColumns({f"_number_{i}": parse_number(F.col(f"_text_{i}")) for i in place.values()})
    return rows, lambda name: F.col(f"_text_{place[name]}"), lambda name: F.col(f"_number_{place[name]}")


def batch_problems(prepared: DataFrame) -> DataFrame:
    """Number of unreadable values per import and indicator."""
    return prepared.groupBy("import_id", "indicator_code").agg(F.count_if(F.col("value").isNull()).alias("value_problem_count"))


def batch_problem_samples(prepared: DataFrame, rows: int = PROBLEM_SAMPLES) -> DataFrame:
    """The first problem rows per import and indicator."""
    bad = prepared.filter(F.col("value").isNull()).select(
        "import_id", "indicator_code", "sheet_name", "row_number", "source_measure"
    )
    keys, order = ["import_id", "indicator_code"], ["row_number", "sheet_name", "source_measure"]
    return first_per_key(few_per_key(bad, keys, order, rows), keys, *[F.col(c) for c in order], rows=rows)


def with_prepared_cells(
    staged: DataFrame, selection: PeriodSelection, mappings: list[IndicatorMapping], municipality_field: str,
    municipalities: DataFrame,
) -> DataFrame:
    """Staged rows with the batch written into the prepared cells, earlier indicators kept.

    Indicator values and calculations are JSON objects by indicator code, as a staged row stores them.
    """
    check_mappings(mappings)
    rows = prepare_places_and_periods(staged, selection, municipality_field, municipalities)
    rows, _, number = _with_numbers(_with_texts(rows, mappings), mappings)
    fields = {APPROVAL_CODE_FIELD: F.col("municipality_code")}
    period_fields = {
        "reference_year": F.col("period")["year"].cast("string"),
        "reference_period": month_start_text(F.col("period")),
    }
    text = {m.indicator_code: number_text(m.value(number)) for m in mappings}
    fields |= {m.prepared_field: text[m.indicator_code] for m in mappings}

    def merged_json(field: str, added: dict[str, Column]) -> Column:
        earlier = F.coalesce(F.from_json(F.try_element_at("normalized_row", F.lit(field)), "map<string,string>"), F.expr("map()").cast("map<string,string>"))
        return F.to_json(put_fields(earlier, added), {"ignoreNullFields": "false"})

    fields["indicator_values"] = merged_json("indicator_values", text)
    fields["indicator_calculations"] = merged_json(
        "indicator_calculations", {m.indicator_code: F.lit(m.calculation_json()) for m in mappings}
    )
    row = put_fields(F.col("normalized_row"), fields)
    # A prepared period that cannot be read stays as it was; in all other modes it is cleared.
    with_period = put_fields(row, period_fields, drop_nulls=True)
    if selection.mode == "prepared":
        with_period = F.when(F.col("period").isNotNull(), with_period).otherwise(row)
    return rows.select(*[c for c in staged.columns if c != "normalized_row"], with_period.alias("normalized_row"))


def preview_rows(
    staged: DataFrame, calculation: str, direct_field: str = "", numerator_field: str = "", denominator_field: str = "",
    multiplier: float = 1.0,
) -> DataFrame:
    """Calculated value of every row of a formula preview (US grouping first, as previews read numbers)."""
    _check_formula(calculation, direct_field, numerator_field, denominator_field, multiplier)
    if calculation == "direct":
        numerator, denominator = _cell(direct_field), F.lit(None).cast("string")
        value = parse_number_us_first(numerator).cast("double")
    else:
        numerator, denominator = _cell(numerator_field), _cell(denominator_field)
        value = ratio(parse_number_us_first(numerator), parse_number_us_first(denominator), multiplier)
    place = F.coalesce(*[_cell(name) for name in ("municipality_ibge_code", "municipio", "municipality")])
    return staged.select(
        "import_id", "sheet_name", "row_number", place.alias("municipality"), numerator.alias("numerator"),
        denominator.alias("denominator"), value.alias("calculated_value"), value.isNotNull().alias("is_valid"),
    )


def _check_formula(calculation, direct_field, numerator_field, denominator_field, multiplier) -> None:
    if calculation not in ("direct", "ratio"):
        raise ValueError("a calculation is direct or ratio")
    if calculation == "direct" and not direct_field:
        raise ValueError("choose the column that holds the value")
    if calculation == "ratio" and (
        not numerator_field or not denominator_field or numerator_field == denominator_field or not 0 < (multiplier or 0) <= 1_000_000
    ):
        raise ValueError("choose numerator, denominator and a valid multiplier")


def preview_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("is_valid").alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("invalid_rows"),
    )


def preview_examples(rows: DataFrame, examples: int = PREVIEW_EXAMPLES) -> DataFrame:
    """The first rows of a preview."""
    return rows.orderBy("row_number", "import_id", "sheet_name").limit(examples)


def prepare_ratio(staged: DataFrame, numerator_field: str, denominator_field: str, multiplier: float) -> DataFrame:
    """Write a ratio and its formula into the prepared cells of every row."""
    _check_formula("ratio", "", numerator_field, denominator_field, multiplier)
    value = ratio(parse_number_us_first(_cell(numerator_field)), parse_number_us_first(_cell(denominator_field)), multiplier)
    fields = {
        "value": number_text(value.try_cast(STORED)),
        "calculation_type": F.lit("ratio"),
        "calculation_numerator_field": F.lit(numerator_field),
        "calculation_denominator_field": F.lit(denominator_field),
        "calculation_multiplier": F.lit(f"{multiplier:g}"),
    }
    return staged.withColumn("value", value).withColumn("normalized_row", put_fields(F.col("normalized_row"), fields))
