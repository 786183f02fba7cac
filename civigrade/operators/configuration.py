"""Weights, benchmarks, their history, and checks of catalog rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.naming import column_name
from civigrade.functions.scoring import DIRECTIONS, PROFILES
from civigrade.functions.text import strip
from civigrade.operators.joins import lookup, upsert

# Dimensions of the index (code, name, colour, order, default weight).
INDEX_DIMENSIONS = (
    ("eco", "Economia", "#f59e0b", 1, "14.28"),
    ("pes", "Pessoas", "#ec4899", 2, "14.28"),
    ("gov", "Governança", "#8b5cf6", 3, "14.28"),
    ("mob", "Mobilidade", "#3b82f6", 4, "14.28"),
    ("amb", "Ambiente", "#10b981", 5, "14.29"),
    ("qvi", "Qualidade de Vida", "#f97316", 6, "14.29"),
    ("idd", "Infraestrutura Digital e Dados", "#06b6d4", 7, "14.30"),
)
WEIGHT_PATTERN = "^[0-9]+([.][0-9]{1,2})?$"
WEIGHT_TOLERANCE = 0.01
HISTORY_ROWS = 30
MOST_SNAPSHOT_ROWS = 100_000

# Longest texts of a collection source, and its code and link rules.
SOURCE_TEXT_LIMITS = {
    "dimension": 80, "factor": 120, "name": 200, "definition": 600, "unit": 80, "source": 200, "steps": 1200, "notes": 1200,
}
SOURCE_CODE = "^[A-Z0-9_]{2,30}$"
INDICATOR_CODE = "^[a-z][a-z0-9_]{2,99}$"
LINK_FIELDS = ("official_link", "import_url", "manual_url")
LONGEST_LINK = 2000
LARGEST_MULTIPLIER = 1_000_000


def seed_dimensions(spark) -> DataFrame:
    return spark.createDataFrame(
        [row[:4] for row in INDEX_DIMENSIONS], "dimension_code string, dimension_name string, color string, display_order int"
    )


def seed_weights(spark) -> DataFrame:
    """Default weight of every dimension for every city profile."""
    defaults = spark.createDataFrame([(row[0], row[4]) for row in INDEX_DIMENSIONS], "dimension_code string, weight string")
    return defaults.select(
        F.explode(F.array(*[F.lit(p) for p in PROFILES])).alias("city_profile"),
        "dimension_code",
        F.col("weight").cast("decimal(5,2)").alias("weight"),
    )


def check_weights(weights: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Problems of proposed weights (``city_profile, dimension_code, weight`` as text), one row each.

    Every dimension needs one weight above 0 and up to 100 with at most two decimals; a profile sums to 100.
    """
    known = lookup(dimensions.select("dimension_code", F.lit(True).alias("_known")))
    number = F.when(F.col("weight").rlike(WEIGHT_PATTERN), F.col("weight").try_cast("decimal(10,2)"))
    rows = weights.join(known, "dimension_code", "left").withColumn("_number", number)
    bad = F.col("_known").isNull() | F.col("_number").isNull() | (F.col("_number") <= 0) | (F.col("_number") > 100)
    wrong = rows.filter(F.coalesce(bad, F.lit(True))).select(
        "city_profile", "dimension_code", F.lit("each weight must be above 0 and at most 100").alias("problem")
    )
    totals = rows.groupBy("city_profile").agg(
        F.sum("_number").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("dimension_code").alias("different")
    )
    expected = dimensions.agg(F.count(F.lit(1)).alias("n")).scalar()
    none = F.lit(None).cast("string").alias("dimension_code")
    count = totals.filter((F.col("n") != expected) | (F.col("n") != F.col("different"))).select(
        "city_profile", none, F.lit("give exactly one weight per dimension").alias("problem")
    )
    off = F.coalesce(F.abs(F.col("total") - 100) > WEIGHT_TOLERANCE, F.lit(True))
    total = totals.filter(off).select("city_profile", none, F.lit("the weights must sum to 100").alias("problem"))
    profile = totals.filter(~F.col("city_profile").isin(*PROFILES)).select(
        "city_profile", none, F.lit("unknown city profile").alias("problem")
    )
    return reduce(DataFrame.unionByName, [wrong, count, total, profile])


def save_weights(current: DataFrame, weights: DataFrame, problems: DataFrame) -> DataFrame:
    """Weights with those of the profiles without problems put in."""
    good = weights.join(problems.select("city_profile").distinct(), "city_profile", "left_anti").select(
        "city_profile", "dimension_code", F.col("weight").try_cast("decimal(5,2)").alias("weight")
    )
    return upsert(current, good, ["city_profile", "dimension_code"])


def check_benchmarks(proposed: DataFrame, indicators: DataFrame) -> DataFrame:
    """Problems of proposed ranges: inverted, unknown profile, indicator missing or not in the index."""
    usable = lookup(
        indicators.filter(F.col("active") & F.col("in_index")).select("indicator_code", F.lit(True).alias("_usable"))
    )
    rows = proposed.join(usable, "indicator_code", "left")
    problem = (
        F.when(~F.col("city_profile").isin(*PROFILES), "unknown city profile")
        .when(~F.coalesce(F.col("minimum_value") < F.col("maximum_value"), F.lit(False)), "the maximum must be above the minimum")
        .when(F.col("_usable").isNull(), "indicator is not in the index")
    )
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        "indicator_code", "city_profile", "problem"
    )


def save_benchmarks(current: DataFrame, proposed: DataFrame, problems: DataFrame) -> DataFrame:
    """Ranges with the proposed ones that have no problem put in."""
    key = ["indicator_code", "city_profile"]
    return upsert(current, proposed.join(problems, key, "left_anti").select(*current.columns), key)


def configuration_view(dimensions: DataFrame, weights: DataFrame, indicators: DataFrame, benchmarks: DataFrame, profile: str):
    """Dimensions with weights and indicators with ranges of one city profile."""
    weighted = dimensions.join(weights.filter(F.col("city_profile") == profile), "dimension_code")
    ranges = benchmarks.filter(F.col("city_profile") == profile).select("indicator_code", "minimum_value", "maximum_value")
    return weighted, indicators.join(ranges, "indicator_code", "left")


def recent_changes(history: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    return history.orderBy(F.col("changed_at").desc(), F.col("entity_type"), F.col("entity_key")).limit(rows)


def audit_changes(entity: str, before: DataFrame, after: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Rows inserted, updated and deleted between two snapshots, with old and new values as JSON."""
    values = [c for c in before.columns if c not in keys]
    old = before.select(*keys, F.struct(*before.columns).alias("_old"))
    new = after.select(*keys, F.struct(*before.columns).alias("_new"))
    joined = old.join(new, keys, "full")
    differs = reduce(Column.__or__, [~F.col("_old")[c].eqNullSafe(F.col("_new")[c]) for c in values])
    changed = joined.filter(F.col("_old").isNull() | F.col("_new").isNull() | differs)
    return changed.select(
        F.lit(entity).alias("entity_type"),
        F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("entity_key"),
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update").alias("operation"),
        F.to_json("_old").alias("old_values"),
        F.to_json("_new").alias("new_values"),
        now.alias("changed_at"),
    )


def snapshot(tables: dict[str, DataFrame], most_rows: int = MOST_SNAPSHOT_ROWS) -> DataFrame:
    """A configuration model as one JSON document. Configuration tables only: the rows of each, at most ``most_rows``, become one array."""
    too_many = F.raise_error(F.lit(f"a snapshot holds at most {most_rows} rows of a table"))
    document = None
    for name, df in tables.items():
        limited = df.select(F.struct(*df.columns).alias("row")).limit(most_rows + 1)
        rows = limited.agg(F.when(F.count(F.lit(1)) > most_rows, too_many).otherwise(F.sort_array(F.collect_list("row"))).alias(name))
        document = rows if document is None else document.withColumn(name, rows.scalar())
    return document.select(F.to_json(F.struct(*tables)).alias("document"))


def save_snapshot(history: DataFrame, name: str, tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """History with the snapshot added, unless one of that name exists."""
    taken = history.filter(F.col("entity_key") == name).select("entity_key").distinct()
    added = snapshot(tables).select(
        F.lit("snapshot").alias("entity_type"), F.lit(name).alias("entity_key"), F.col("document").alias("new_values"), now.alias("changed_at")
    )
    return history.unionByName(added.join(taken, "entity_key", "left_anti"), allowMissingColumns=True)


def seed(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog with literal rows put in."""
    return upsert(current, rows, keys)


def _problems(df: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, bad, m in rules])
    )
    return df.select(F.col(key).alias("code"), F.explode(broken).alias("p")).select("code", "p.field", "p.message")


def check_indicators(indicators: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Broken rules of indicator rows: code, multiplier, and the parts an indicator of the index needs."""
    known = lookup(dimensions.select(F.col("dimension_code"), F.lit(True).alias("_known")).distinct())
    rows = indicators.join(known, "dimension_code", "left")
    multiplier, maximum = F.col("calculation_multiplier"), F.col("checklist_max")
    is_checklist = F.col("score_direction") == "checklist"
    in_index = F.col("in_index")
    has_parts = F.col("dimension_code").isNotNull() & F.coalesce(F.col("score_direction").isin(*DIRECTIONS), F.lit(False))
    good_multiplier = F.coalesce((multiplier > 0) & (multiplier <= LARGEST_MULTIPLIER) & ~F.isnan(multiplier), F.lit(False))
    good_maximum = F.coalesce((maximum > 0) & ~F.isnan(maximum) & (maximum < float("inf")), F.lit(False))
    rules = [
        ("code", ~F.coalesce(column_name(F.col("indicator_code")).rlike(INDICATOR_CODE), F.lit(False)), "code must be 3 to 100 lower-case letters, digits or underscores"),
        ("calculation_multiplier", ~good_multiplier, "multiplier must be above 0 and at most 1,000,000"),
        ("score_direction", in_index & ~has_parts, "an index indicator needs a dimension and a direction"),
        ("checklist_max", in_index & has_parts & is_checklist & ~good_maximum, "a checklist needs a maximum"),
        ("checklist_max", in_index & has_parts & ~is_checklist & maximum.isNotNull(), "only a checklist has a maximum"),
        ("dimension_code", in_index & has_parts & F.col("_known").isNull(), "unknown dimension"),
    ]
    return _problems(rows, "indicator_code", rules)


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def source_code(code: Column) -> Column:
    return F.upper(strip(code))


def check_sources(sources: DataFrame) -> DataFrame:
    """Broken rules of collection-source rows: code, text lengths, links."""
    rules = [("code", ~F.coalesce(source_code(F.col("code")).rlike(SOURCE_CODE), F.lit(False)), "code must be 2 to 30 capital letters, digits or underscores")]
    for name, limit in SOURCE_TEXT_LIMITS.items():
        rules.append((name, F.length(_text(name)) > limit, f"{name} is longer than {limit} characters"))
    for name in LINK_FIELDS:
        link = _text(name)
        good = F.startswith(link, F.lit("https://")) & (F.length(link) <= LONGEST_LINK) & ~F.contains(link, F.lit(" "))
        rules.append((name, (link != "") & ~good, "links start with https:// and have no blanks"))
    return _problems(sources, "code", rules)


def clean_sources(sources: DataFrame, longest_need: int | None = None, most_needs: int | None = None) -> DataFrame:
    """Collection sources as they are stored: trimmed texts, defaults, no empty links or needs.

    With ``longest_need`` and ``most_needs`` needs are cut to so many characters and entries.
    """
    code = source_code(F.col("code"))
    empty = lambda c: F.when(c != "", c)
    fields = {name: _text(name) for name in SOURCE_TEXT_LIMITS}
    fields["dimension"] = F.coalesce(empty(fields["dimension"]), F.lit("Outras"))
    fields["name"] = F.coalesce(empty(fields["name"]), code)
    fields["notes"] = empty(fields["notes"])
    fields |= {name: empty(_text(name)) for name in LINK_FIELDS}
    fields["import_url"] = F.when(F.col("access") == "link", fields["import_url"])
    needs = F.filter(F.transform("needs", lambda n: strip(n)), lambda n: n != "")
    if longest_need is not None:
        needs = F.transform(needs, lambda n: F.left(n, F.lit(longest_need)))
    if most_needs is not None:
        needs = F.slice(needs, 1, most_needs)
    return sources.select(code.alias("code"), *[c.alias(n) for n, c in fields.items()], "access", needs.alias("needs"))
