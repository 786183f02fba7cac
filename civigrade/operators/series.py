"""Serving pages and time series of published values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.periods import period_label
from civigrade.operators.index import with_place_names
from civigrade.operators.joins import attach_counted


def indicator_summary(published: DataFrame) -> DataFrame:
    """Observations, first and last period per municipality and indicator."""
    return published.groupBy("municipality_ibge_code", "indicator_code", "indicator_name", "unit").agg(
        F.count(F.lit(1)).alias("observations"),
        F.min("reference_period").alias("first_period"),
        F.max("reference_period").alias("last_period"),
    )


def indicator_series(published: DataFrame, municipality_code: str, indicator_code: str) -> DataFrame:
    """Values of one indicator of a municipality in order of time, with their origin."""
    return published.filter(
        (F.col("municipality_ibge_code") == municipality_code) & (F.col("indicator_code") == indicator_code)
    ).orderBy("reference_period", "id")


def has_number(value: Column) -> Column:
    """Whether a value is there and finite."""
    return F.coalesce(F.abs(value.cast("double")) < F.lit(float("inf")), F.lit(False))


def series_granularity(published: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a series is monthly: a point says so, or no point says anything and one is not in January."""
    flagged = F.col("period_granularity")
    return published.groupBy(*keys).agg(
        F.when(F.max(F.coalesce(flagged == "month", F.lit(False))), True)
        .when(F.count(flagged) > 0, False)
        .otherwise(F.max(F.month("reference_period") != 1))
        .alias("is_monthly"),
        F.count(F.lit(1)).alias("points"),
    )


def labelled_points(published: DataFrame, keys: list[str]) -> DataFrame:
    """Points with a value and a label at the granularity of their series."""
    points = attach_counted(published, series_granularity(published, keys), keys).drop("points")
    labelled = points.withColumn("label", period_label(F.col("reference_period"), F.col("is_monthly")))
    return labelled.filter(has_number(F.col("value")))


def series_summary(published: DataFrame, keys: list[str]) -> DataFrame:
    """First, last, lowest and highest point per series (the earliest on a tie), change and change in percent.

    Only partial aggregates: a series of any length is summed up before it is shuffled.
    """
    value, period = F.col("value"), F.col("reference_period")
    at = F.struct(period, F.col("id"))
    late = F.struct(period, F.col("id"))
    points = published.filter(has_number(value))
    low = F.min(F.struct(value.alias("value"), period.alias("period")))
    high = F.min(F.struct((-value).alias("value"), period.alias("period")))
    first, last = F.min_by(value, at), F.max_by(value, late)
    summary = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min(period).alias("first_period"), first.alias("first_value"),
        F.max(period).alias("last_period"), last.alias("last_value"),
        low["period"].alias("min_period"), low["value"].alias("min_value"),
        high["period"].alias("max_period"), (-high["value"]).alias("max_value"),
    )
    change = F.col("last_value") - F.col("first_value")
    return summary.withColumn("change", change).withColumn(
        "change_percent", F.try_divide(F.col("change"), F.abs("first_value")) * 100
    )


def serving_page(rows: DataFrame, municipalities: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of serving rows, newest period first, with the municipality as ``name (state)``."""
    if limit < 1 or offset < 0:
        raise ValueError("a page needs a positive limit and an offset that is not negative")
    page = rows.orderBy(F.col("reference_period").desc(), F.col("id").asc()).offset(offset).limit(limit)
    named = with_place_names(page, municipalities)
    label = F.when(F.col("state").isNotNull(), F.concat("name", F.lit(" ("), "state", F.lit(")")))
    return named.withColumn("municipality_name", label).drop("name", "state")


def total_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))
