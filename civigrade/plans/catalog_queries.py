"""Coverage, collection catalog and configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civigrade.operators import configuration, coverage, coverage_index, filters
from civigrade.plans import model
from civigrade.plans.registry import Registry
from civigrade.session import scratch_folder

query = Registry()


def _coverage_rows(spark, folder):
    """Serving rows by part: taxed items have indicators of their own, so that some parts have no data. Two spellings of a code merge."""
    line = model.table(spark, folder, "lineitem")
    letter = F.when(F.col("l_tax") != 0, F.lit("q")).when(F.col("l_linestatus") == "F", F.lit("p")).otherwise(F.lit("P"))
    code = F.concat(letter, F.col("l_partkey").cast("string"))
    return line.select(
        code.alias("indicator_code"), model.municipality_code(F.col("l_suppkey")).alias("municipality_ibge_code"),
        F.trunc("l_shipdate", "month").alias("reference_period"),
    )


COVERAGE_SQL = """coverage AS (
  SELECT CASE WHEN l_tax <> 0 THEN 'q' WHEN l_linestatus = 'F' THEN 'p' ELSE 'P' END || l_partkey AS indicator_code, count(DISTINCT l_suppkey) AS municipalities,
    count(*) AS value_count, min(date_trunc('month', l_shipdate)) AS first_p, max(date_trunc('month', l_shipdate)) AS last_p
  FROM lineitem GROUP BY 1),
by_code AS (
  SELECT upper(indicator_code) AS short_code, max(municipalities) AS municipalities, CAST(sum(value_count) AS BIGINT) AS value_count,
    min(first_p) AS first_p, max(last_p) AS last_p FROM coverage GROUP BY 1)"""


def _texts(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("first_period", "last_period")})


@query(
    "a12_indicator_coverage",
    f"""WITH {model.PUBLISHED_SQL} SELECT indicator_code, count(DISTINCT municipality_ibge_code) AS municipalities, count(*) AS value_count,
  CAST(min(reference_period) AS VARCHAR) AS first_period, CAST(max(reference_period) AS VARCHAR) AS last_period FROM published GROUP BY 1""",
)
def indicator_coverage(spark, folder):
    return _texts(coverage.indicator_coverage(model.published(spark, folder)))


@query(
    "a13_coverage_by_code",
    f"""WITH {COVERAGE_SQL} SELECT short_code, municipalities, value_count, strftime(first_p, '%Y-%m-%d') AS first_period, strftime(last_p, '%Y-%m-%d') AS last_period FROM by_code""",
)
def coverage_by_code(spark, folder):
    return _texts(coverage.coverage_by_code(coverage.indicator_coverage(_coverage_rows(spark, folder))))


def _items(spark, folder):
    access = F.when(F.col("p_size") <= 20, "link").when(F.col("p_size") <= 40, "manual").otherwise("local")
    return model.table(spark, folder, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_partkey").alias("position"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("source"), F.col("p_type").alias("factor"), access.alias("access"),
        F.when(F.col("p_size") == 1, F.lit(" ")).otherwise(F.col("p_type")).alias("dimension"),
    )


def _by_code(spark, folder):
    return coverage.coverage_by_code(coverage.indicator_coverage(_coverage_rows(spark, folder)))


COVERAGE_SLOTS = 16


def _kept_coverage(spark, folder):
    """Coverage kept while three imports come one after another."""

    def write(path):
        published = model.published(spark, folder)
        for import_id in ("F", "O", "P"):
            coverage_index.put(coverage_index.coverage_at(spark, path, COVERAGE_SLOTS), published.filter(F.col("import_id") == import_id))

    return coverage_index.coverage_at(spark, model.stored(spark, folder, "coverage", write), COVERAGE_SLOTS)


_CHOICES = {"all": ("F", "O", "P"), "F": ("F",), "O": ("O",), "P": ("P",), "O or P": ("O", "P")}


@query(
    "a12_kept_coverage",
    f"""WITH {model.PUBLISHED_SQL} SELECT choice, indicator_code, count(DISTINCT municipality_ibge_code) AS municipalities, count(*) AS value_count,
  CAST(min(reference_period) AS VARCHAR) AS first_period, CAST(max(reference_period) AS VARCHAR) AS last_period
FROM published JOIN (VALUES {", ".join(f"('{name}', '{i}')" for name, ids in _CHOICES.items() for i in ids)}) c(choice, chosen) ON import_id = chosen GROUP BY ALL""",
)
def kept_coverage(spark, folder):
    """Coverage of several choices of imports, from the bitmaps alone."""
    choices = model.literal_table(spark, [(name, i) for name, ids in _CHOICES.items() for i in ids], "choice", "import_id")
    summaries = coverage_index.kept(_kept_coverage(spark, folder)).join(F.broadcast(choices), "import_id")
    return _texts(coverage_index.merged(summaries, ("choice",)))


@query(
    "a12_withdrawn_coverage",
    f"""WITH {model.PUBLISHED_SQL} SELECT indicator_code, count(DISTINCT municipality_ibge_code) AS municipalities, count(*) AS value_count,
  CAST(min(reference_period) AS VARCHAR) AS first_period, CAST(max(reference_period) AS VARCHAR) AS last_period
FROM published WHERE import_id <> 'F' OR NOT starts_with(indicator_code, 'eco') GROUP BY 1""",
)
def withdrawn_coverage(spark, folder):
    """Two imports are withdrawn, one of them comes again without its economic indicators."""
    index = coverage_index.coverage_at(spark, scratch_folder(spark, "coverage"), COVERAGE_SLOTS)
    published = model.published(spark, folder)
    coverage_index.put(index, published)
    coverage_index.withdraw(index, model.literal_table(spark, [("F",), ("P",)], "import_id"))
    again = (F.col("import_id") == "P") | (F.col("import_id") == "F") & ~F.col("indicator_code").startswith("eco")
    coverage_index.put(index, published.filter(again))
    return _texts(coverage_index.indicator_coverage(index))


@query(
    "a13_kept_coverage_by_code",
    f"""WITH {model.PUBLISHED_SQL}, coverage AS (SELECT indicator_code, count(DISTINCT municipality_ibge_code) AS municipalities, count(*) AS value_count,
  min(reference_period) AS first_p, max(reference_period) AS last_p FROM published GROUP BY 1)
SELECT upper(split_part(indicator_code, '_', 1)) AS short_code, municipalities, value_count, CAST(first_p AS VARCHAR) AS first_period, CAST(last_p AS VARCHAR) AS last_period FROM coverage""",
)
def kept_coverage_by_code(spark, folder):
    return _texts(coverage.coverage_by_code(coverage_index.indicator_coverage(_kept_coverage(spark, folder))))


@query(
    "q17_kept_impact",
    f"""WITH {model.PUBLISHED_SQL} SELECT i.import_id, count(p.id) AS rows, count(DISTINCT indicator_code) AS indicators
FROM (VALUES ('F'), ('O'), ('P'), ('none')) i(import_id) LEFT JOIN published p USING (import_id) GROUP BY 1""",
)
def kept_impact(spark, folder):
    return coverage_index.impact(_kept_coverage(spark, folder), model.literal_table(spark, [("F",), ("O",), ("P",), ("none",)], "import_id"))


@query("a14_without_data", f"WITH {COVERAGE_SQL} SELECT 'p' || p_partkey AS code FROM part WHERE 'P' || p_partkey NOT IN (SELECT short_code FROM by_code)")
def without_data(spark, folder):
    return coverage.without_data(_items(spark, folder), _by_code(spark, folder)).select("code")


@query("a14_with_data", f"WITH {COVERAGE_SQL} SELECT 'p' || p_partkey AS code FROM part WHERE 'P' || p_partkey IN (SELECT short_code FROM by_code)")
def with_data(spark, folder):
    return coverage.with_data(_items(spark, folder), _by_code(spark, folder)).select("code")


@query(
    "f11_u4_collection_filter",
    f"""WITH {COVERAGE_SQL} SELECT 'p' || p_partkey AS code FROM part WHERE p_size BETWEEN 21 AND 40 AND 'P' || p_partkey NOT IN (SELECT short_code FROM by_code)
  AND contains(lower('p' || p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')""",
)
def collection_filter(spark, folder):
    covered = _by_code(spark, folder).filter(F.col("value_count") > 0)
    return filters.collection_rows(_items(spark, folder), "manual", " Brand#1", covered).select("code")


@query(
    "a15_counts_by_access",
    "SELECT CASE WHEN p_size <= 20 THEN 'link' WHEN p_size <= 40 THEN 'manual' ELSE 'local' END AS access, count(*) AS items FROM part GROUP BY 1",
)
def counts_by_access(spark, folder):
    return coverage.counts_by_access(_items(spark, folder))


@query(
    "a15_u5_dimensions_in_order",
    "SELECT CASE WHEN p_size = 1 THEN ' ' ELSE p_type END AS dimension, min(p_partkey) AS first_position FROM part GROUP BY 1",
)
def dimensions_in_order(spark, folder):
    return coverage.dimensions_in_order(_items(spark, folder))


@query(
    "a15_group_by_dimension",
    """SELECT 'p' || p_partkey AS code, CASE WHEN p_size = 1 THEN 'Sem dimensão' ELSE p_type END AS dimension_group,
  min(p_partkey) OVER (PARTITION BY dimension_group) AS group_position FROM part""",
)
def group_by_dimension(spark, folder):
    return coverage.group_by_dimension(_items(spark, folder)).select("code", "dimension_group", "group_position")


def _merged(spark, folder):
    items = _items(spark, folder)
    size = model.table(spark, folder, "part").select(F.col("p_partkey").alias("position"), "p_size")
    sized = items.join(size, "position")
    base = sized.filter(F.col("p_size") <= 30).select(*items.columns)
    saved = sized.filter(F.col("p_size") >= 25).withColumn("name", F.concat(F.lit("saved "), "name")).select(*items.columns)
    return coverage.merge_overrides(base, saved)


@query(
    "u3_merge_overrides",
    """WITH merged AS (SELECT 'p' || p_partkey AS code, p_partkey, CASE WHEN p_size >= 25 THEN 'saved ' || p_name ELSE p_name END AS name,
  CASE WHEN p_size > 30 THEN 'custom' WHEN p_size >= 25 THEN 'edited' ELSE 'base' END AS origin, CASE WHEN p_size = 1 THEN ' ' ELSE p_type END AS dimension,
  (CASE WHEN p_size > 30 THEN 1 ELSE 0 END, p_partkey) AS place FROM part)
SELECT code, name, origin, dimension, first(code ORDER BY place) OVER (PARTITION BY dimension ORDER BY place) AS first_of_dimension FROM merged""",
)
def merge_overrides(spark, folder):
    rows = _merged(spark, folder)
    first = F.concat(F.lit("p"), F.col("dimension_place.position").cast("string"))
    return rows.select("code", "name", "origin", "dimension", first.alias("first_of_dimension"))


# Configuration: nations stand for dimensions, their customers and orders for what is configured.
def _weights(spark, folder):
    """Proposed weights per profile: four dimensions, one profile each with a different fault."""
    region = model.table(spark, folder, "region")
    profiles = F.array(*[F.lit(p) for p in ("pequeno", "medio", "grande", "metropole", "other")])
    rows = region.select(F.explode(profiles).alias("city_profile"), F.col("r_name").alias("dimension_code"), "r_regionkey")
    weight = (
        F.when((F.col("city_profile") == "medio") & (F.col("r_regionkey") == 0), "0")
        .when((F.col("city_profile") == "grande") & (F.col("r_regionkey") == 1), "20.005")
        .when((F.col("city_profile") == "metropole") & (F.col("r_regionkey") == 2), "20.02")
        .otherwise("20.00")
    )
    return rows.select("city_profile", "dimension_code", weight.alias("weight"))


def _regions(spark, folder):
    return model.table(spark, folder, "region").select(F.col("r_name").alias("dimension_code"))


WEIGHTS_SQL = """weights AS (
  SELECT city_profile, r_name AS dimension_code, CASE WHEN city_profile = 'medio' AND r_regionkey = 0 THEN '0'
    WHEN city_profile = 'grande' AND r_regionkey = 1 THEN '20.005' WHEN city_profile = 'metropole' AND r_regionkey = 2 THEN '20.02' ELSE '20.00' END AS weight
  FROM region, (SELECT unnest(['pequeno', 'medio', 'grande', 'metropole', 'other']) AS city_profile)),
checked AS (SELECT *, CASE WHEN regexp_full_match(weight, '[0-9]+([.][0-9]{1,2})?') THEN CAST(weight AS DECIMAL(10, 2)) END AS n FROM weights),
problems AS (
  SELECT city_profile, dimension_code, 'each weight must be above 0 and at most 100' AS problem FROM checked WHERE n IS NULL OR n <= 0 OR n > 100
  UNION ALL SELECT city_profile, NULL, 'the weights must sum to 100' FROM checked GROUP BY 1 HAVING abs(sum(n) - 100) > 0.01
  UNION ALL SELECT DISTINCT city_profile, NULL, 'unknown city profile' FROM checked WHERE city_profile = 'other')"""


@query("c1_check_weights", f"WITH {WEIGHTS_SQL} SELECT * FROM problems")
def check_weights(spark, folder):
    return configuration.check_weights(_weights(spark, folder), _regions(spark, folder))


@query(
    "c1_save_weights",
    f"""WITH {WEIGHTS_SQL}, good AS (SELECT city_profile, dimension_code, CAST(n AS DOUBLE) AS weight FROM checked WHERE city_profile NOT IN (SELECT city_profile FROM problems)),
before AS (SELECT p AS city_profile, r_name AS dimension_code, 10.0 AS weight FROM region, (SELECT unnest(['pequeno', 'medio', 'grande', 'metropole']) AS p))
SELECT * FROM good UNION ALL SELECT * FROM before WHERE (city_profile, dimension_code) NOT IN (SELECT (city_profile, dimension_code) FROM good)""",
)
def save_weights(spark, folder):
    proposed, dimensions = _weights(spark, folder), _regions(spark, folder)
    profiles = F.array(*[F.lit(p) for p in ("pequeno", "medio", "grande", "metropole")])
    current = dimensions.select(F.explode(profiles).alias("city_profile"), "dimension_code", F.lit(10).cast("decimal(5,2)").alias("weight"))
    saved = configuration.save_weights(current, proposed, configuration.check_weights(proposed, dimensions))
    return saved.select("city_profile", "dimension_code", F.col("weight").cast("double").alias("weight"))


def _ranges(spark, folder):
    """Proposed benchmark ranges: one per part; some inverted, some of inactive or unknown indicators."""
    part = model.table(spark, folder, "part")
    high = F.when(F.col("p_size") == 7, F.lit(1.0)).otherwise(F.col("p_retailprice"))
    profile = F.when(F.col("p_size") == 9, F.lit("other")).otherwise(F.lit("medio"))
    return part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("indicator_code"), profile.alias("city_profile"),
        F.lit(1.0).alias("minimum_value"), high.alias("maximum_value"),
    )


def _part_indicators(spark, folder):
    part = model.table(spark, folder, "part")
    letter = F.when(F.col("p_size") == 11, F.lit("z")).otherwise(F.lit("p"))  # ranges of these parts have no indicator
    return part.select(
        F.concat(letter, F.col("p_partkey").cast("string")).alias("indicator_code"), (F.col("p_size") != 13).alias("active"), F.lit(True).alias("in_index")
    )


RANGE_PROBLEMS_SQL = """range_problems AS (
  SELECT 'p' || p_partkey AS indicator_code, CASE WHEN p_size = 9 THEN 'other' ELSE 'medio' END AS city_profile,
    CASE p_size WHEN 9 THEN 'unknown city profile' WHEN 7 THEN 'the maximum must be above the minimum' ELSE 'indicator is not in the index' END AS problem
  FROM part WHERE p_size IN (7, 9, 11, 13))"""


@query("c2_check_benchmarks", f"WITH {RANGE_PROBLEMS_SQL} SELECT * FROM range_problems")
def check_benchmarks(spark, folder):
    return configuration.check_benchmarks(_ranges(spark, folder), _part_indicators(spark, folder))


@query(
    "c2_save_benchmarks",
    """SELECT 'p' || p_partkey AS indicator_code, 'medio' AS city_profile, CASE WHEN p_size IN (7, 9, 11, 13) THEN 5.0 ELSE p_retailprice END AS maximum_value
FROM part WHERE p_size NOT IN (7, 9, 11, 13) OR p_type = 'ECONOMY'
UNION ALL SELECT 'y' || p_partkey, 'medio', 5.0 FROM part WHERE p_type <> 'ECONOMY'""",
)
def save_benchmarks(spark, folder):
    proposed = _ranges(spark, folder)
    letter = F.when(F.col("p_type") == "ECONOMY", F.lit("p")).otherwise(F.lit("y"))
    current = model.table(spark, folder, "part").select(
        F.concat(letter, F.col("p_partkey").cast("string")).alias("indicator_code"), F.lit("medio").alias("city_profile"),
        F.lit(0.0).alias("minimum_value"), F.lit(5.0).alias("maximum_value"),
    )
    problems = configuration.check_benchmarks(proposed, _part_indicators(spark, folder))
    return configuration.save_benchmarks(current, proposed, problems).drop("minimum_value")


@query(
    "c3_configuration_view",
    """SELECT CASE p_size WHEN 11 THEN 'z' ELSE 'p' END || p_partkey AS indicator_code,
  CASE WHEN p_size NOT IN (9, 11) THEN CASE WHEN p_size = 7 THEN 1.0 ELSE p_retailprice END END AS maximum_value FROM part""",
)
def configuration_view(spark, folder):
    indicators, ranges = _part_indicators(spark, folder), _ranges(spark, folder)
    weights = configuration.seed_weights(spark)
    _, view = configuration.configuration_view(configuration.seed_dimensions(spark), weights, indicators, ranges, "medio")
    return view.select("indicator_code", "maximum_value")


def _history(spark, folder):
    """Changes between two states of the suppliers: the poorest and the richest change their key, some are renamed."""
    supplier, key, balance = model.table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal"), F.col("s_suppkey"), F.col("s_acctbal")
    before = supplier.withColumn("s_suppkey", F.when(balance >= 9000, -key - 1).otherwise(key))
    after = supplier.withColumn("s_suppkey", F.when(balance <= 1000, key + 1_000_000_000).otherwise(key)).withColumn(
        "s_name", F.when(balance > 5000, F.upper("s_name")).otherwise(F.col("s_name"))
    )
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    return configuration.audit_changes("supplier", before, after, ["s_suppkey"], now)


CHANGES_SQL = """changes AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS entity_key, 'update' AS operation, s_name AS old_name, upper(s_name) AS new_name
  FROM supplier WHERE s_acctbal > 5000 AND s_acctbal < 9000
  UNION ALL SELECT CAST(CASE WHEN s_acctbal >= 9000 THEN -s_suppkey - 1 ELSE s_suppkey END AS VARCHAR), 'delete', s_name, NULL
  FROM supplier WHERE s_acctbal <= 1000 OR s_acctbal >= 9000
  UNION ALL SELECT CAST(CASE WHEN s_acctbal <= 1000 THEN s_suppkey + 1000000000 ELSE s_suppkey END AS VARCHAR), 'insert', NULL,
    CASE WHEN s_acctbal >= 9000 THEN upper(s_name) ELSE s_name END FROM supplier WHERE s_acctbal <= 1000 OR s_acctbal >= 9000)"""


@query("c4_audit_changes", f"WITH {CHANGES_SQL} SELECT * FROM changes")
def audit_changes(spark, folder):
    name = lambda column: F.get_json_object(column, "$.s_name")
    return _history(spark, folder).select("entity_key", "operation", name("old_values").alias("old_name"), name("new_values").alias("new_name"))


@query("c3_recent_changes", f"WITH {CHANGES_SQL} SELECT entity_key, operation FROM changes ORDER BY entity_key LIMIT 30")
def recent_changes(spark, folder):
    return configuration.recent_changes(_history(spark, folder)).select("entity_key", "operation")


@query(
    "c5_snapshot",
    """SELECT 'region' AS part, r_regionkey AS key, r_name AS name, CAST(NULL AS BIGINT) AS region FROM region
UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation""",
)
def snapshot(spark, folder):
    tables = {"regions": model.table(spark, folder, "region"), "nations": model.table(spark, folder, "nation")}
    regions, nations = "regions array<struct<r_regionkey:long,r_name:string>>", "nations array<struct<n_nationkey:long,n_name:string,n_regionkey:long>>"
    parsed = configuration.snapshot(tables).select(F.from_json("document", f"{regions}, {nations}").alias("d"))
    none = F.lit(None).cast("long")
    first = parsed.select(F.inline("d.regions")).select(F.lit("region").alias("part"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), none.alias("region"))
    second = parsed.select(F.inline("d.nations")).select(F.lit("nation"), "n_nationkey", "n_name", "n_regionkey")
    return first.union(second)


@query(
    "c5_saved_snapshot",
    """SELECT 'model 1' AS entity_key, (SELECT count(*) FROM region) AS regions UNION ALL SELECT 'model 2', (SELECT count(*) FROM region)""",
)
def saved_snapshot(spark, folder):
    """A second model is added to the history, the first one is not saved again."""
    tables = {"regions": model.table(spark, folder, "region")}
    none = spark.createDataFrame([], "entity_type string, entity_key string, new_values string, changed_at timestamp")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    history = none
    for name in ("model 1", "model 2", "model 1"):
        history = configuration.save_snapshot(history, name, tables, now)
    regions = F.from_json("new_values", "regions array<struct<r_regionkey:long>>")["regions"]
    return history.select("entity_key", F.size(regions).cast("long").alias("regions"))


@query(
    "c6_seed_weights",
    """SELECT p AS city_profile, d AS dimension_code, CASE d WHEN 'idd' THEN 14.3 WHEN 'amb' THEN 14.29 WHEN 'qvi' THEN 14.29 ELSE 14.28 END AS weight
FROM (SELECT unnest(['pequeno', 'medio', 'grande', 'metropole']) AS p), (SELECT unnest(['eco', 'pes', 'gov', 'mob', 'amb', 'qvi', 'idd']) AS d)
UNION ALL SELECT r_name, 'eco', CAST(r_regionkey AS DOUBLE) FROM region""",
)
def seed_weights(spark, folder):
    """Default weights put into a table that holds the regions' own weights."""
    current = model.table(spark, folder, "region").select(
        F.col("r_name").alias("city_profile"), F.lit("eco").alias("dimension_code"), F.col("r_regionkey").cast("decimal(5,2)").alias("weight")
    )
    seeded = configuration.seed(current, configuration.seed_weights(spark), ["city_profile", "dimension_code"])
    return seeded.withColumn("weight", F.col("weight").cast("double"))


@query(
    "q20_check_indicators",
    """SELECT 'p' || p_partkey AS code, 'calculation_multiplier' AS field FROM part WHERE p_size = 1
UNION ALL SELECT CASE WHEN p_size = 2 THEN '9p' ELSE 'p' END || p_partkey, 'code' FROM part WHERE p_size = 2 OR (p_size <> 2 AND length('p' || p_partkey) < 3)
UNION ALL SELECT 'p' || p_partkey, 'score_direction' FROM part WHERE p_size = 3
UNION ALL SELECT 'p' || p_partkey, 'checklist_max' FROM part WHERE p_size IN (4, 5)
UNION ALL SELECT 'p' || p_partkey, 'dimension_code' FROM part WHERE p_size = 6""",
)
def check_indicators(spark, folder):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    direction = F.when(size == 3, "manual").when(size == 4, "checklist").otherwise("direct")
    rows = model.table(spark, folder, "part").select(
        F.concat(F.when(size == 2, F.lit("9P")).otherwise(F.lit("P")), key).alias("raw_code"),
        F.when(size == 1, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("calculation_multiplier"), F.lit(True).alias("in_index"),
        F.when(size == 6, F.lit("zzz")).otherwise(F.lit("eco")).alias("dimension_code"), direction.alias("score_direction"),
        F.when(size == 5, F.lit(10.0)).alias("checklist_max"),
    ).withColumn("indicator_code", F.lower("raw_code"))
    return configuration.check_indicators(rows, model.dimensions(spark)).select("code", "field")


def _sources(spark, folder):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    texts = {name: F.col("p_name") for name in configuration.SOURCE_TEXT_LIMITS}
    texts["unit"] = F.when(size == 1, F.repeat(F.lit("x"), F.lit(81))).otherwise(F.lit(" kg "))
    texts["dimension"] = F.when(size == 2, F.lit("  ")).otherwise(F.col("p_type"))
    return model.table(spark, folder, "part").select(
        F.concat(F.when(size == 3, F.lit("p-")).otherwise(F.lit(" pk")), key).alias("code"), *[c.alias(n) for n, c in texts.items()],
        F.when(size == 4, F.lit("http://a.b")).otherwise(F.lit("https://a.b/c")).alias("official_link"), F.lit("").alias("import_url"),
        F.when(size == 5, F.lit("https://a b")).alias("manual_url"), F.lit("manual").alias("access"),
        F.split("p_name", " ").alias("needs"),
    )


@query(
    "q20_check_sources",
    """SELECT CASE WHEN p_size = 3 THEN 'p-' ELSE ' pk' END || p_partkey AS code, CASE p_size WHEN 1 THEN 'unit' WHEN 3 THEN 'code' WHEN 4 THEN 'official_link' ELSE 'manual_url' END AS field
FROM part WHERE p_size IN (1, 3, 4, 5)""",
)
def check_sources(spark, folder):
    return configuration.check_sources(_sources(spark, folder)).select("code", "field")


@query(
    "q20_clean_sources",
    """SELECT upper(CASE WHEN p_size = 3 THEN 'p-' ELSE 'pk' END || p_partkey) AS code, CASE WHEN p_size = 2 THEN 'Outras' ELSE p_type END AS dimension,
  CASE WHEN p_size = 1 THEN repeat('x', 81) ELSE 'kg' END AS unit, CAST(NULL AS VARCHAR) AS import_url, replace(p_name, ' ', '|') AS needs FROM part""",
)
def clean_sources(spark, folder):
    rows = configuration.clean_sources(_sources(spark, folder))
    return rows.select("code", "dimension", "unit", "import_url", F.array_join("needs", "|").alias("needs"))
