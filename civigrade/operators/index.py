"""Composite index: diagnosis, ranking, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.scoring import indicator_score, maturity
from civigrade.functions.text import search_key
from civigrade.operators.joins import attach_counted, latest, lookup, prefix_sums
from civigrade.session import materialise

MOST_INDICATORS = 10_000
RANKING_SORTS = ("score", "name", "state", "coverage")
MUNICIPALITY_CODE = "^[0-9]{7}$"


def ordered_sum(terms: Column, order: Column) -> Column:
    """Aggregate: sum of the terms that are not null, added in a fixed order, so that equal scores come out equal to the last bit.

    The groups are those of one municipality, with one term per indicator or dimension.
    """
    listed = F.sort_array(F.collect_list(F.when(terms.isNotNull(), F.struct(order.alias("o"), terms.cast("double").alias("t")))))
    return F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda total, item: total + item["t"]))


def scorable_indicators(indicators: DataFrame, dimensions: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Indicators of a known dimension that are checklists or have a benchmark, with their range."""
    ranges = benchmarks.select("indicator_code", "minimum_value", "maximum_value")
    return (
        indicators.join(dimensions.select("dimension_code"), "dimension_code", "left_semi")
        .join(ranges, "indicator_code", "left")
        .filter((F.col("score_direction") == "checklist") | F.col("minimum_value").isNotNull())
    )


def score_latest(
    published: DataFrame, indicators: DataFrame, dimensions: DataFrame, benchmarks: DataFrame, codes: str = MUNICIPALITY_CODE
) -> DataFrame:
    """One row per municipality and scorable indicator: latest value and its score.

    Needs ``municipality_ibge_code, indicator_code, reference_period, value, id``. ``codes`` is the pattern of a municipality's code; rows
    with other codes are left out. Where ids repeat, the lower value is the latest, so no row depends on how the catalog is joined.
    """
    catalog = scorable_indicators(indicators, dimensions, benchmarks).select(
        "indicator_code", "dimension_code", "score_direction", "minimum_value", "maximum_value", "checklist_max"
    )
    catalog = lookup(catalog)
    known = published.select("municipality_ibge_code", "indicator_code", "reference_period", "value", "id").filter(
        F.col("municipality_ibge_code").rlike(codes)
    )
    newest = latest(
        known.join(catalog.select("indicator_code"), "indicator_code", "left_semi"),
        ["municipality_ibge_code", "indicator_code"], "reference_period", ["id", "value"],
    )
    return newest.join(catalog, "indicator_code").withColumn(
        "score",
        indicator_score(
            F.col("value"), F.col("score_direction"), F.col("minimum_value"), F.col("maximum_value"), F.col("checklist_max")
        ),
    )


def dimension_scores(scored: DataFrame) -> DataFrame:
    """Mean score per municipality and dimension, with observed and scored counts."""
    return scored.groupBy("municipality_ibge_code", "dimension_code").agg(
        (ordered_sum(F.col("score"), F.col("indicator_code")) / F.count("score")).alias("dimension_score"),
        F.count("value").alias("observed_indicators"),
        F.count("score").alias("scored_indicators"),
    )


def overall_scores(by_dimension: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Weighted mean of the present dimensions, maturity and counts per municipality."""
    weights = lookup(dimensions.select("dimension_code", F.col("weight").cast("double").alias("weight")))
    present = F.col("dimension_score").isNotNull()
    return (
        by_dimension.join(weights, "dimension_code")
        .groupBy("municipality_ibge_code")
        .agg(
            F.try_divide(
                ordered_sum(F.col("dimension_score") * F.col("weight"), F.col("dimension_code")),
                ordered_sum(F.when(present, F.col("weight")), F.col("dimension_code")),
            ).alias("overall_score"),
            F.map_from_entries(F.collect_list(F.struct("dimension_code", "dimension_score"))).alias("dimension_scores"),
            F.sum("observed_indicators").alias("observed_indicators"),
            F.sum("scored_indicators").alias("scored_indicators"),
        )
        .withColumn("overall_score", F.when(F.col("overall_score") > 100, 100.0).otherwise(F.col("overall_score")))
        .withColumn("maturity", maturity(F.col("overall_score")))
    )


def with_place_names(df: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Add name (the code where unknown) and state."""
    places = municipalities.select(F.col("ibge_code").alias("municipality_ibge_code"), "name", "state")
    return df.join(lookup(places), "municipality_ibge_code", "left").withColumn(
        "name", F.coalesce("name", "municipality_ibge_code")
    )


def rank_municipalities(
    published: DataFrame, indicators: DataFrame, dimensions: DataFrame, benchmarks: DataFrame, municipalities: DataFrame,
    codes: str = MUNICIPALITY_CODE,
) -> DataFrame:
    """Overall score of every municipality that has one, with names; not yet ranked."""
    scored = score_latest(published, indicators, dimensions, benchmarks, codes)
    overall = overall_scores(dimension_scores(scored), dimensions).filter(F.col("overall_score").isNotNull())
    return with_place_names(overall, municipalities)


def competition_rank(df: DataFrame, score: Column, alias: str = "rank") -> DataFrame:
    """Competition rank of exact scores (only equal ones share a rank), highest first; rows without score are dropped.

    No task sees all rows or all scores: scores are counted, the distinct ones are dealt out by range, summed inside their range, and
    the sums of the ranges above are added. Rows and counts are written once, since later steps read them again.
    """
    rows = materialise(df.withColumn("_score", score).filter(F.col("_score").isNotNull()), "scored")
    counts = rows.groupBy("_score").agg(F.count(F.lit(1)).alias("_rows"))
    placed = materialise(counts.repartitionByRange(F.col("_score").desc()).withColumn("_range", F.spark_partition_id()), "scores")
    ranges = placed.groupBy("_range").agg(F.sum("_rows").alias("_range_rows"))
    ranges = prefix_sums(ranges, [], F.col("_range"), "_range_rows", "_above").drop("_range_rows")
    inside = prefix_sums(placed, ["_range"], F.col("_score").desc(), "_rows", "_before")
    ranks = inside.join(ranges, "_range").select("_score", "_rows", (F.col("_above") + F.col("_before") + 1).cast("long").alias(alias))
    return attach_counted(rows, ranks, ["_score"], null_keys=False).drop("_score", "_rows")


def ranking_page(
    ranked: DataFrame,
    dimension: str | None = None,
    search: str | None = None,
    sort: str = "score",
    descending: bool | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of the ranking. Ranks are given before the search, so a found row keeps its real rank.

    ``sort`` is ``score``, ``name``, ``state``, ``coverage`` or a dimension code (rows without that score last); anything else, and a
    dimension that no row has, is refused. Ascending scores are the descending order read backwards.
    """
    if limit < 1 or offset < 0:
        raise ValueError("a page needs a positive limit and an offset that is not negative")
    if sort not in RANKING_SORTS:
        _check_dimension(ranked, sort)
    rows = ranking_matches(ranked, dimension, search)
    if descending is None:
        descending = sort not in ("name", "state")
    name, code = search_key(F.col("name")), F.col("municipality_ibge_code")
    if sort == "score":
        order = [F.col("score").desc(), name.asc(), code.asc()] if descending else [F.col("score").asc(), name.desc(), code.desc()]
        return rows.orderBy(*order).offset(offset).limit(limit)
    keys = {"name": [name], "state": [F.coalesce("state", F.lit("")), name], "coverage": [F.col("scored_indicators")]}.get(
        sort, [F.try_element_at("dimension_scores", F.lit(sort))]
    )
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last() for key in keys]
    return rows.orderBy(*order, F.col("rank").asc(), name.asc(), code.asc()).offset(offset).limit(limit)


def _check_dimension(ranked: DataFrame, code: str) -> None:
    if ranked.filter(F.map_contains_key("dimension_scores", code)).isEmpty():
        raise ValueError(f"unknown dimension or order: {code}")


def ranking_matches(ranked: DataFrame, dimension: str | None = None, search: str | None = None) -> DataFrame:
    """All ranked rows a ranking query matches: by overall or one dimension score, then by search text."""
    if dimension is not None and dimension.strip():
        dimension = dimension.strip()
        _check_dimension(ranked, dimension)
        score = F.try_element_at("dimension_scores", F.lit(dimension))
    else:
        score = F.col("overall_score")
    rows = competition_rank(ranked.withColumn("score", score), F.col("score"))
    return rows.filter(_found(search)) if search and search.strip() else rows


def _found(search: str) -> Column:
    text = search_key(F.concat_ws(" ", "name", F.coalesce("state", F.lit("")), "municipality_ibge_code"))
    return F.contains(text, search_key(F.lit(search.strip())))


def ranking_totals(ranked: DataFrame, dimension: str | None = None, search: str | None = None) -> DataFrame:
    """One row: scored municipalities, and how many of them the search matches."""
    rows = ranking_matches(ranked, dimension)
    hit = _found(search) if search and search.strip() else F.lit(True)
    return rows.agg(F.count(F.lit(1)).alias("scored_municipalities"), F.count_if(hit).alias("total"))


def diagnosis(
    published: DataFrame, indicators: DataFrame, dimensions: DataFrame, benchmarks: DataFrame, codes: list[str] | None = None
) -> DataFrame:
    """Indicator detail per municipality: latest value, benchmark and score of every catalog indicator.

    Indicators without a value are listed too, per municipality that has any value at all.
    """
    values = published.select(
        "municipality_ibge_code", "indicator_code", "reference_period", "value", "unit", "source_name", "id"
    )
    if codes:
        values = values.filter(F.col("municipality_ibge_code").isin(*codes))
    catalog = indicators.join(dimensions.select("dimension_code"), "dimension_code", "left_semi").join(
        benchmarks.select("indicator_code", "minimum_value", "maximum_value"), "indicator_code", "left"
    )
    newest = latest(values, ["municipality_ibge_code", "indicator_code"], "reference_period", ["id"]).select(
        "municipality_ibge_code", "indicator_code", F.struct("reference_period", "value", "source_name").alias("latest")
    )
    in_catalog = newest.join(catalog.select(F.col("indicator_code").alias("_code"), F.lit(True).alias("_listed")), F.col("indicator_code") == F.col("_code"), "left")
    own = F.when(F.col("_listed"), F.struct("indicator_code", "latest"))  # a place with other indicators only is listed too
    per_place = in_catalog.groupBy("municipality_ibge_code").agg(F.map_from_entries(F.collect_list(own)).alias("by_indicator"))
    # The catalog as one row, exploded per municipality: the answer has all its indicators for each.
    listed = catalog.select(F.struct(*catalog.columns).alias("indicator")).limit(MOST_INDICATORS + 1)
    rows = listed.agg(F.when(F.count(F.lit(1)) > MOST_INDICATORS, F.raise_error(F.lit(f"more than {MOST_INDICATORS} indicators"))).otherwise(F.collect_list("indicator")).alias("all"))
    listed = per_place.withColumn("indicator", F.explode(rows.scalar()))
    value = F.try_element_at("by_indicator", F.col("indicator.indicator_code"))
    return listed.select(
        "municipality_ibge_code",
        *[F.col(f"indicator.{c}").alias(c) for c in catalog.columns],
        value["reference_period"].alias("reference_period"),
        value["value"].alias("value"),
        value["source_name"].alias("source_name"),
    ).withColumn(
        "score",
        indicator_score(
            F.col("value"), F.col("score_direction"), F.col("minimum_value"), F.col("maximum_value"), F.col("checklist_max")
        ),
    )


def diagnosis_summary(detail: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Per municipality and dimension: mean score and counts of scored, observed and catalog indicators."""
    return detail.groupBy("municipality_ibge_code", "dimension_code").agg(
        (ordered_sum(F.col("score"), F.col("indicator_code")) / F.count("score")).alias("dimension_score"),
        F.count("score").alias("scored_indicators"),
        F.count("value").alias("observed_indicators"),
        F.count(F.lit(1)).alias("total_indicators"),
    )


def strongest_and_weakest(by_dimension: DataFrame) -> DataFrame:
    """Best and worst dimension per municipality and the number of indicators without a value.

    On equal scores the first dimension code is the strongest, the last one the weakest; with
    fewer than two scores there is no weakest.
    """
    scored = F.col("dimension_score").isNotNull()
    lower_first = (-F.col("dimension_score")).alias("s")
    best = F.min(F.when(scored, F.struct(lower_first, F.col("dimension_code").alias("d"))))
    worst = F.max(F.when(scored, F.struct(lower_first, F.col("dimension_code").alias("d"))))
    return by_dimension.groupBy("municipality_ibge_code").agg(
        best["d"].alias("strongest_dimension"),
        F.when(F.count("dimension_score") > 1, worst["d"]).alias("weakest_dimension"),
        F.greatest(F.sum(F.col("total_indicators") - F.col("observed_indicators")), F.lit(0)).alias("missing_indicators"),
    )


def compare(detail: DataFrame, codes: list[str]) -> DataFrame:
    """Two to four different municipalities, in the order asked for."""
    wanted = list(dict.fromkeys(code.strip() for code in codes if code.strip()))
    if not 2 <= len(wanted) <= 4:
        raise ValueError("choose two to four different municipalities")
    place = F.array_position(F.array(*[F.lit(c) for c in wanted]), F.col("municipality_ibge_code"))
    return detail.filter(F.col("municipality_ibge_code").isin(*wanted)).withColumn("place", place.cast("int"))


def comparison_table(detail: DataFrame, codes: list[str]) -> DataFrame:
    """Side by side: one row per indicator, value, period and score of each municipality as columns."""
    compared = compare(detail, codes)
    wanted = list(dict.fromkeys(code.strip() for code in codes if code.strip()))
    return (
        compared.groupBy("dimension_code", "indicator_code")
        .pivot("municipality_ibge_code", wanted)
        .agg(
            F.first("value").alias("value"), F.first("reference_period").alias("period"), F.first("score").alias("score")
        )
    )


def best_in_row(df: DataFrame, row: list[str], value: str = "score", alias: str = "is_best") -> DataFrame:
    """Flag the highest value of each row group; none when fewer than two values exist or all are equal.

    The groups are counted first and joined back, so no group is gathered in one task. The rows are
    written once, since both steps read them.
    """
    df = materialise(df, "compared")
    stats = df.groupBy(*row).agg(
        F.max(value).alias("_top"), F.min(value).alias("_low"), F.count(value).alias("_present"), F.count(F.lit(1)).alias("_n")
    )
    rows = attach_counted(df, stats, row)
    flag = (F.col("_present") >= 2) & (F.col("_low") < F.col("_top")) & (F.col(value) == F.col("_top"))
    return rows.withColumn(alias, F.coalesce(flag, F.lit(False))).drop("_top", "_low", "_present", "_n")
