"""Data coverage per indicator and the catalog of collection sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civigrade.functions.text import short_code, strip
from civigrade.operators.joins import attach_counted


def indicator_coverage(serving: DataFrame) -> DataFrame:
    """Municipalities, values, first and last period per indicator.

    Counted per indicator and municipality first, so one large indicator is spread over all tasks.
    """
    per_place = serving.groupBy("indicator_code", "municipality_ibge_code").agg(
        F.count(F.lit(1)).alias("rows"), F.min("reference_period").alias("first"), F.max("reference_period").alias("last")
    )
    return per_place.groupBy("indicator_code").agg(
        F.count("municipality_ibge_code").alias("municipalities"),
        F.sum("rows").alias("value_count"),
        F.min("first").alias("first_period"),
        F.max("last").alias("last_period"),
    )


def coverage_by_code(coverage: DataFrame) -> DataFrame:
    """Coverage merged by matrix code: most municipalities, sum of values, widest period."""
    return coverage.groupBy(short_code(F.col("indicator_code")).alias("short_code")).agg(
        F.max("municipalities").alias("municipalities"),
        F.sum("value_count").alias("value_count"),
        F.min("first_period").alias("first_period"),
        F.max("last_period").alias("last_period"),
    )


def without_data(items: DataFrame, by_code: DataFrame) -> DataFrame:
    covered = by_code.filter(F.col("value_count") > 0).select("short_code")
    return items.withColumn("short_code", F.upper("code")).join(covered, "short_code", "left_anti").drop("short_code")


def with_data(items: DataFrame, by_code: DataFrame) -> DataFrame:
    covered = by_code.filter(F.col("value_count") > 0).select("short_code")
    return items.withColumn("short_code", F.upper("code")).join(covered, "short_code", "left_semi").drop("short_code")


def counts_by_access(items: DataFrame) -> DataFrame:
    return items.groupBy("access").agg(F.count(F.lit(1)).alias("items"))


def dimensions_in_order(items: DataFrame, position: str = "position") -> DataFrame:
    """Different dimensions with the position each is first seen at."""
    return items.groupBy("dimension").agg(F.min(position).alias("first_position"))


def group_by_dimension(indicators: DataFrame, position: str = "position") -> DataFrame:
    """Indicators with the label of their dimension group and the order of the groups."""
    label = strip(F.coalesce("dimension", F.lit("")))
    named = indicators.withColumn("dimension_group", F.when(label == "", F.lit("Sem dimensão")).otherwise(label))
    first = named.groupBy("dimension_group").agg(F.min(position).alias("group_position"), F.count(F.lit(1)).alias("_items"))
    return attach_counted(named, first, ["dimension_group"]).drop("_items")


def merge_overrides(base: DataFrame, saved: DataFrame) -> DataFrame:
    """Base items with saved ones of the same code in their place, and the other saved ones after them.

    Both have ``code, position, dimension`` and the same other columns. ``origin`` is base, edited or
    custom; ``dimension_position`` and ``position`` give the listing order.
    """
    fields = [c for c in base.columns if c not in ("code", "position")]
    ours = base.select("code", F.col("position").alias("_base_position"), F.struct(*fields).alias("_base"))
    theirs = saved.select("code", F.col("position").alias("_saved_position"), F.struct(*fields).alias("_saved"))
    joined = ours.join(theirs, "code", "full")
    chosen = F.coalesce("_saved", "_base")
    merged = joined.select(
        "code",
        *[chosen[c].alias(c) for c in fields],
        F.when(F.col("_base").isNull(), "custom").when(F.col("_saved").isNotNull(), "edited").otherwise("base").alias("origin"),
        F.struct(
            F.col("_base").isNull().cast("int").alias("after"), F.coalesce("_base_position", "_saved_position").alias("position")
        ).alias("place"),
    )
    first = merged.groupBy("dimension").agg(F.min("place").alias("dimension_place"), F.count(F.lit(1)).alias("_items"))
    return attach_counted(merged, first, ["dimension"]).drop("_items")


def in_listing_order(merged: DataFrame) -> DataFrame:
    return merged.orderBy("dimension_place", "place", "code")
