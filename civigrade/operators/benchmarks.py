"""Benchmark ranges from published values, by city profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civigrade.functions.scoring import PROFILES, city_profile
from civigrade.operators.joins import attach_counted, latest, lookup, prefix_sums
from civigrade.session import materialise

# Percentiles of a range and the samples it needs.
LOW_PERCENTILE, HIGH_PERCENTILE = 0.10, 0.90
MINIMUM_SAMPLE = {"pequeno": 30, "medio": 30, "grande": 30, "metropole": 10}
OVERALL_SAMPLE = 30
RELIABLE_SAMPLE = 30
MINIMUM_POPULATION_ROWS = 1000
CENSUS_YEAR = 2022
OVERALL = "geral"

# Groups up to this size are sorted whole; larger ones only inside a bracket around the wanted rank.
SMALL_GROUP = 10_000
SKETCH_ACCURACY = 10_000
BRACKET = 0.001


def latest_values(published: DataFrame) -> DataFrame:
    """Latest row with a value per indicator and municipality."""
    present = published.filter(F.col("value").isNotNull() & (F.col("municipality_ibge_code") != "")).select(
        "indicator_code", "municipality_ibge_code", "reference_period", F.col("value").cast("double").alias("value"), "id"
    )
    return latest(present, ["indicator_code", "municipality_ibge_code"], "reference_period", ["id"])


def exact_percentiles(df: DataFrame, group: list[str], fractions: dict[str, float], small_group: int = SMALL_GROUP) -> DataFrame:
    """Exact, linearly interpolated percentiles of ``value`` per group, for groups of any size.

    A sketch brackets the wanted rank and exact counts place it: everything below the bracket is only
    counted, and only the distinct values inside it (0.2 % of the ranks) are sorted. ``df`` is read three
    times: pass a stored table.
    """
    names, places = list(fractions), list(fractions.values())
    probes = [p for place in places for p in (max(place - BRACKET, 0.0), min(place + BRACKET, 1.0))]
    probe_list = ", ".join(f"{p!r}D" for p in probes)
    present = df.select(*group, "value").filter(F.col("value").isNotNull())
    brackets = present.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.expr(f"percentile_approx(value, array({probe_list}), {SKETCH_ACCURACY})").alias("_probes"),
    )
    rows = attach_counted(present, brackets, group)

    is_large = F.col("_n") > small_group
    wanted = []
    for index, place in enumerate(places):
        low = F.when(is_large & F.lit(place > BRACKET), F.col("_probes")[2 * index])
        high = F.when(is_large & F.lit(place < 1 - BRACKET), F.col("_probes")[2 * index + 1])
        below = F.coalesce(F.col("value") < low, F.lit(False))
        above = F.coalesce(F.col("value") > high, F.lit(False))
        # Values below the bracket share one null key, values above it are not needed.
        wanted.append(F.when(~above, F.struct(F.lit(index).alias("place"), F.when(~below, F.col("value")).alias("key"))))
    keyed = rows.select(*group, "_n", F.explode(F.array_compact(F.array(*wanted))).alias("_w"))
    counts = keyed.groupBy(*group, "_n", F.col("_w.place").alias("_place"), F.col("_w.key").alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    summed = prefix_sums(counts, [*group, "_place"], F.col("_key").asc_nulls_first(), "_rows", "_before")

    position = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(p) for p in places]), F.col("_place") + 1)
    lower = F.floor(position)
    upper = F.least(lower + 1, F.col("_n") - 1)
    reached = F.col("_before") + F.col("_rows")
    placed = summed.select(*group, "_n", "_place", "_key", position.alias("_at"), lower.alias("_lo"),
                           (reached > lower).alias("_past_lo"), (reached > upper).alias("_past_hi"))
    picked = placed.groupBy(*group, "_n", "_place", "_at", "_lo").agg(
        F.min(F.when(F.col("_past_lo"), F.col("_key"))).alias("_low_value"),
        F.min(F.when(F.col("_past_hi"), F.col("_key"))).alias("_high_value"),
    )
    step = F.col("_low_value") + (F.col("_high_value") - F.col("_low_value")) * (F.col("_at") - F.col("_lo"))
    per_place = [F.max(F.when(F.col("_place") == i, step)).alias(name) for i, name in enumerate(names)]
    return picked.groupBy(*group).agg(F.max("_n").alias("sample_size"), *per_place)


def _ranges(values: DataFrame, group: list[str]) -> DataFrame:
    """P10-P90 range per group where it has an extent."""
    return as_ranges(exact_percentiles(values, group, {"_low": LOW_PERCENTILE, "_high": HIGH_PERCENTILE}), group)


def as_ranges(found: DataFrame, group: list[str]) -> DataFrame:
    """Ranges from percentiles ``_low`` and ``_high`` and the ``sample_size`` behind them."""
    return found.filter(F.col("_low") < F.col("_high")).select(
        *group,
        "sample_size",
        F.round("_low", 4).alias("minimum_value"),
        F.round("_high", 4).alias("maximum_value"),
        F.when(F.col("sample_size") >= RELIABLE_SAMPLE, F.lit("alta")).otherwise(F.lit("baixa")).alias("reliability"),
    )


def suggest_benchmarks(published: DataFrame) -> DataFrame:
    """P10-P90 range of every indicator with at least 30 municipalities, with observed extremes and periods."""
    values = materialise(latest_values(published), "latest")
    observed = values.groupBy("indicator_code").agg(
        F.min("value").alias("observed_minimum"),
        F.max("value").alias("observed_maximum"),
        F.min("reference_period").alias("first_period"),
        F.max("reference_period").alias("last_period"),
    )
    ranges = _ranges(values, ["indicator_code"]).filter(F.col("sample_size") >= OVERALL_SAMPLE)
    return ranges.drop("reliability").join(observed, "indicator_code")


def profile_benchmarks(published: DataFrame, population: DataFrame) -> DataFrame:
    """Range per indicator and city profile, and one over all municipalities (profile ``geral``).

    ``population`` has ``ibge_code, inhabitants``. Groups below their minimum sample are left out.
    """
    people = lookup(population.select(F.col("ibge_code").alias("municipality_ibge_code"), "inhabitants"))
    values = latest_values(published).join(people, "municipality_ibge_code", "left")
    profiles = F.array_compact(F.array(city_profile(F.col("inhabitants")), F.lit(OVERALL)))
    grouped = materialise(values.select("indicator_code", "value", F.explode(profiles).alias("city_profile")), "latest")
    return sufficient(_ranges(grouped, ["indicator_code", "city_profile"]))


def sufficient(ranges: DataFrame) -> DataFrame:
    """Ranges of profiles with their minimum sample."""
    needed = F.lit(OVERALL_SAMPLE)
    for profile, sample in MINIMUM_SAMPLE.items():
        needed = F.when(F.col("city_profile") == profile, F.lit(sample)).otherwise(needed)
    return ranges.filter(F.col("sample_size") >= needed)


def automatic_benchmarks(
    published: DataFrame, population: DataFrame, indicators: DataFrame, profiles: list[str] | None = None, codes: list[str] | None = None
) -> DataFrame:
    """A range for every catalog indicator with values and every profile, or for the chosen ``codes`` and ``profiles``.

    ``origin`` is ``porte`` (own profile), ``geral`` (all municipalities) or null with a ``reason`` when skipped.
    """
    unknown = [p for p in profiles or [] if p not in PROFILES]
    if unknown:
        raise ValueError(f"unknown city profiles: {', '.join(unknown)}")
    if codes is not None:
        indicators, published = (df.filter(F.col("indicator_code").isin(*codes)) for df in (indicators, published))
    with_values = indicators.select("indicator_code").join(
        published.select("indicator_code").distinct(), "indicator_code", "left_semi"
    )
    return offered(with_values, profile_benchmarks(published, population), profiles)


def offered(with_values: DataFrame, ranges: DataFrame, profiles: list[str] | None = None) -> DataFrame:
    """The own range of every indicator and profile, else the one over all municipalities, else a reason."""
    wanted = with_values.withColumn("city_profile", F.explode(F.array(*[F.lit(p) for p in profiles or PROFILES])))
    fields = ["sample_size", "minimum_value", "maximum_value", "reliability"]
    # All profiles of an indicator meet in one row (five at most), so the ranges are computed once.
    by_profile = ranges.groupBy("indicator_code").agg(
        F.map_from_entries(F.collect_list(F.struct("city_profile", F.struct(*fields).alias("range")))).alias("by_profile")
    )
    own = F.try_element_at("by_profile", F.col("city_profile"))
    overall = F.try_element_at("by_profile", F.lit(OVERALL))
    chosen = wanted.join(by_profile, "indicator_code", "left").withColumn("range", F.coalesce(own, overall))
    return chosen.select(
        "indicator_code",
        "city_profile",
        F.when(own.isNotNull(), F.lit("porte")).when(overall.isNotNull(), F.lit(OVERALL)).alias("origin"),
        *[F.col("range")[f].alias(f) for f in fields],
        F.when(F.col("range").isNull(), F.lit("amostra insuficiente")).alias("reason"),
    )


def as_profile_catalog(automatic: DataFrame, profile: str) -> DataFrame:
    """Benchmark catalog of one profile, as the index reads it."""
    return automatic.filter((F.col("city_profile") == profile) & F.col("origin").isNotNull()).select(
        "indicator_code", "minimum_value", "maximum_value"
    )


def latest_population(population: DataFrame, this_year: int) -> DataFrame:
    """Population of the newest usable year: this year, up to three years back, then the census year.

    A year is usable with at least 1000 municipalities. ``population`` has ``year, ibge_code, inhabitants``.
    """
    years = list(dict.fromkeys([this_year - back for back in range(4)] + [CENSUS_YEAR]))
    preference = F.array_position(F.array(*[F.lit(y) for y in years]), F.col("year").cast("int"))
    usable = (
        population.filter(F.col("year").isin(*years))
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") >= MINIMUM_POPULATION_ROWS)
    )
    chosen = usable.agg(F.min_by("year", preference).alias("year"))
    return population.filter(F.col("year") == chosen.scalar())


def municipality_profiles(population: DataFrame, this_year: int) -> DataFrame:
    """City profile of every municipality by its latest population."""
    return latest_population(population, this_year).select(
        F.col("ibge_code").alias("municipality_ibge_code"),
        "inhabitants",
        F.col("year").alias("population_year"),
        city_profile(F.col("inhabitants")).alias("city_profile"),
    )


def population_years(rows: DataFrame, population: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct years of prepared rows and whether the population of that year is known; more than ``most`` years are refused."""
    years = rows.select("year").filter(F.col("year").isNotNull()).distinct()
    if most is not None and years.limit(most + 1).count() > most:
        raise ValueError(f"use at most {most} different years when dividing by population")
    known = population.groupBy("year").agg(F.count(F.lit(1)).alias("municipalities"))
    usable = known.filter(F.col("municipalities") >= MINIMUM_POPULATION_ROWS)
    return years.join(usable, "year", "left").withColumn("is_missing", F.col("municipalities").isNull())
