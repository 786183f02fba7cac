"""Index, ranking, benchmarks, series and coverage queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civigrade.functions.periods import PeriodSelection
from civigrade.functions.text import search_key
from civigrade.operators import benchmarks as bench
from civigrade.operators import filters, geography, index, pages, preparation, publication, ranges, series
from civigrade.operators.joins import latest, upsert
from civigrade.operators.preparation import IndicatorMapping
from civigrade.plans import model
from civigrade.plans.geography_queries import RESOLVED_SQL
from civigrade.plans.registry import Registry
from civigrade.session import materialise, scratch_folder
from civigrade.sinks import reports

query = Registry()


def _catalogs(spark):
    return model.indicators(spark), model.dimensions(spark), model.benchmarks(spark)


SCORED_SQL = f"""{model.PUBLISHED_SQL}, {model.DIMENSIONS_SQL}, {model.BENCHMARKS_SQL}, {model.MUNICIPALITY_SQL},
catalog AS (
  SELECT i.indicator_code, i.dimension_code, i.score_direction, i.checklist_max, b.minimum_value, b.maximum_value
  FROM indicators i LEFT JOIN benchmarks b USING (indicator_code)
  WHERE i.dimension_code IN (SELECT dimension_code FROM dimensions)
    AND (i.score_direction = 'checklist' OR b.minimum_value IS NOT NULL)),
newest AS (
  SELECT p.*, c.* EXCLUDE (indicator_code) FROM published p JOIN catalog c USING (indicator_code)
  QUALIFY row_number() OVER (PARTITION BY municipality_ibge_code, indicator_code ORDER BY reference_period DESC, id) = 1),
scored AS (
  SELECT *, CASE
    WHEN score_direction = 'checklist' THEN least(100.0, greatest(0.0, value / checklist_max * 100))
    WHEN score_direction = 'direct' THEN least(100.0, greatest(0.0, (value - minimum_value) / (maximum_value - minimum_value) * 100))
    WHEN score_direction = 'inverse' THEN least(100.0, greatest(0.0, (maximum_value - value) / (maximum_value - minimum_value) * 100))
    END AS raw_score,
    CASE WHEN value IS NOT NULL THEN raw_score END AS score
  FROM newest),
by_dimension AS (
  SELECT municipality_ibge_code, dimension_code, avg(score) AS dimension_score,
         count(value) AS observed_indicators, count(score) AS scored_indicators
  FROM scored GROUP BY 1, 2),
overall AS (
  SELECT municipality_ibge_code,
         sum(dimension_score * weight) / sum(CASE WHEN dimension_score IS NOT NULL THEN weight END) AS mean_score,
         CASE WHEN mean_score > 100 THEN 100.0 ELSE mean_score END AS overall_score,
         CAST(sum(observed_indicators) AS BIGINT) AS observed_indicators,
         CAST(sum(scored_indicators) AS BIGINT) AS scored_indicators,
         max(CASE WHEN dimension_code = 'eco' THEN dimension_score END) AS eco_score,
         max(CASE WHEN dimension_code = 'pes' THEN dimension_score END) AS pes_score
  FROM by_dimension JOIN dimensions USING (dimension_code) GROUP BY 1),
ranked AS (
  SELECT o.* EXCLUDE (mean_score), coalesce(m.name, o.municipality_ibge_code) AS name, m.state,
         CASE WHEN overall_score <= 20 THEN 'Nível 1 - Inicial' WHEN overall_score <= 40 THEN 'Nível 2 - Em desenvolvimento'
              WHEN overall_score <= 60 THEN 'Nível 3 - Estruturado' WHEN overall_score <= 80 THEN 'Nível 4 - Gerenciado'
              ELSE 'Nível 5 - Otimizado' END AS maturity
  FROM overall o LEFT JOIN municipality m ON m.ibge_code = o.municipality_ibge_code WHERE overall_score IS NOT NULL)"""


def _ranked(spark, folder):
    return index.rank_municipalities(
        model.published(spark, folder), *_catalogs(spark), model.municipality(spark, folder), model.CODE_PATTERN
    )


@query(
    "a2_ranking",
    f"""WITH {SCORED_SQL}
SELECT CAST(rank() OVER (ORDER BY overall_score DESC) AS BIGINT) AS rank, municipality_ibge_code, name, state,
       round(overall_score, 6) AS overall_score, maturity, round(eco_score, 6) AS eco_score, round(pes_score, 6) AS pes_score,
       observed_indicators, scored_indicators FROM ranked""",
)
def ranking(spark, folder):
    ranked = index.competition_rank(_ranked(spark, folder), F.col("overall_score"))
    return ranked.select(
        "rank", "municipality_ibge_code", "name", "state", F.round("overall_score", 6).alias("overall_score"), "maturity",
        F.round(F.try_element_at("dimension_scores", F.lit("eco")), 6).alias("eco_score"),
        F.round(F.try_element_at("dimension_scores", F.lit("pes")), 6).alias("pes_score"),
        "observed_indicators", "scored_indicators",
    )


SUGGESTED_SQL = f"""WITH {model.PUBLISHED_SQL}, newest AS (
  SELECT * FROM published WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY indicator_code, municipality_ibge_code ORDER BY reference_period DESC, id) = 1)
SELECT indicator_code, count(*) AS sample_size, round(quantile_cont(value, 0.1), 4) AS minimum_value,
       round(quantile_cont(value, 0.9), 4) AS maximum_value, min(value) AS observed_minimum, max(value) AS observed_maximum,
       CAST(min(reference_period) AS VARCHAR) AS first_period, CAST(max(reference_period) AS VARCHAR) AS last_period
FROM newest GROUP BY 1 HAVING count(*) >= 30 AND quantile_cont(value, 0.1) < quantile_cont(value, 0.9)"""


@query("a8_benchmark_suggestion", SUGGESTED_SQL)
def benchmark_suggestion(spark, folder):
    return bench.suggest_benchmarks(model.published(spark, folder)).select(
        "indicator_code", "sample_size", "minimum_value", "maximum_value", "observed_minimum", "observed_maximum",
        F.col("first_period").cast("string").alias("first_period"), F.col("last_period").cast("string").alias("last_period"),
    )


PROFILES_SQL = f"""{model.PUBLISHED_SQL}, {model.POPULATION_SQL}, newest AS (
  SELECT p.*, CASE WHEN inhabitants IS NULL OR inhabitants <= 0 THEN NULL WHEN inhabitants <= 50000 THEN 'pequeno'
                   WHEN inhabitants <= 300000 THEN 'medio' WHEN inhabitants <= 1000000 THEN 'grande' ELSE 'metropole' END AS profile
  FROM published p LEFT JOIN population ON ibge_code = municipality_ibge_code WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY indicator_code, municipality_ibge_code ORDER BY reference_period DESC, id) = 1),
grouped AS (
  SELECT indicator_code, profile AS city_profile, value FROM newest WHERE profile IS NOT NULL
  UNION ALL SELECT indicator_code, 'geral', value FROM newest),
ranges AS (
  SELECT indicator_code, city_profile, count(*) AS sample_size, round(quantile_cont(value, 0.1), 4) AS minimum_value,
         round(quantile_cont(value, 0.9), 4) AS maximum_value,
         CASE WHEN count(*) >= 30 THEN 'alta' ELSE 'baixa' END AS reliability
  FROM grouped GROUP BY 1, 2
  HAVING count(*) >= CASE city_profile WHEN 'metropole' THEN 10 ELSE 30 END
     AND quantile_cont(value, 0.1) < quantile_cont(value, 0.9))"""


@query("a9_profile_benchmarks", f"WITH {PROFILES_SQL} SELECT * FROM ranges")
def profile_benchmarks(spark, folder):
    return bench.profile_benchmarks(model.published(spark, folder), model.population(spark, folder))


AUTOMATIC_SQL = f"""WITH {PROFILES_SQL}, wanted AS (
  SELECT DISTINCT indicator_code, unnest(['pequeno', 'medio', 'grande', 'metropole']) AS city_profile
  FROM published)
SELECT w.indicator_code, w.city_profile,
       CASE WHEN r.indicator_code IS NOT NULL THEN 'porte' WHEN g.indicator_code IS NOT NULL THEN 'geral' END AS origin,
       coalesce(r.sample_size, g.sample_size) AS sample_size, coalesce(r.minimum_value, g.minimum_value) AS minimum_value,
       coalesce(r.maximum_value, g.maximum_value) AS maximum_value, coalesce(r.reliability, g.reliability) AS reliability,
       CASE WHEN r.indicator_code IS NULL AND g.indicator_code IS NULL THEN 'amostra insuficiente' END AS reason
FROM wanted w LEFT JOIN ranges r ON r.indicator_code = w.indicator_code AND r.city_profile = w.city_profile
LEFT JOIN ranges g ON g.indicator_code = w.indicator_code AND g.city_profile = 'geral'"""


@query("a10_automatic_benchmarks", AUTOMATIC_SQL)
def automatic_benchmarks(spark, folder):
    return bench.automatic_benchmarks(
        model.published(spark, folder), model.population(spark, folder), model.indicators(spark)
    )


RANGE_SLOTS = 16


def _kept_ranges(spark, folder):
    """Ranges kept while three imports come one after another."""

    def write(path):
        published, people = model.published(spark, folder), model.population(spark, folder)
        for import_id in ("O", "F", "P"):
            ranges.put(ranges.ranges_at(spark, path, RANGE_SLOTS), published.filter(F.col("import_id") == import_id), people)

    return ranges.ranges_at(spark, model.stored(spark, folder, "ranges", write), RANGE_SLOTS)


@query("a8_kept_suggestion", SUGGESTED_SQL)
def kept_suggestion(spark, folder):
    return ranges.suggest_benchmarks(_kept_ranges(spark, folder)).select(
        "indicator_code", "sample_size", "minimum_value", "maximum_value", "observed_minimum", "observed_maximum",
        F.col("first_period").cast("string").alias("first_period"), F.col("last_period").cast("string").alias("last_period"),
    )


@query("a9_kept_ranges", f"WITH {PROFILES_SQL} SELECT * FROM ranges")
def kept_ranges(spark, folder):
    return ranges.profile_benchmarks(_kept_ranges(spark, folder)).select("indicator_code", "city_profile", "sample_size", "minimum_value", "maximum_value", "reliability")


@query("a10_kept_benchmarks", AUTOMATIC_SQL)
def kept_benchmarks(spark, folder):
    return ranges.automatic_benchmarks(_kept_ranges(spark, folder), model.indicators(spark))


@query(
    "a10_chosen_benchmarks",
    f"""WITH {PROFILES_SQL}, wanted AS (
  SELECT DISTINCT indicator_code, unnest(['medio', 'metropole']) AS city_profile FROM published WHERE indicator_code IN ('eco02_high', 'gov01_low'))
SELECT w.indicator_code, w.city_profile, coalesce(r.sample_size, g.sample_size) AS sample_size, coalesce(r.minimum_value, g.minimum_value) AS minimum_value
FROM wanted w LEFT JOIN ranges r ON r.indicator_code = w.indicator_code AND r.city_profile = w.city_profile
LEFT JOIN ranges g ON g.indicator_code = w.indicator_code AND g.city_profile = 'geral'""",
)
def chosen_benchmarks(spark, folder):
    rows = bench.automatic_benchmarks(
        model.published(spark, folder), model.population(spark, folder), model.indicators(spark), ["medio", "metropole"], ["eco02_high", "gov01_low", "none"]
    )
    return rows.select("indicator_code", "city_profile", "sample_size", "minimum_value")


@query(
    "w1_latest_row",
    f"""WITH {model.PUBLISHED_SQL} SELECT id, municipality_ibge_code, indicator_code, value FROM published
QUALIFY row_number() OVER (PARTITION BY municipality_ibge_code, indicator_code ORDER BY reference_period DESC, id) = 1""",
)
def latest_row(spark, folder):
    keys = ["municipality_ibge_code", "indicator_code"]
    return latest(model.published(spark, folder), keys, "reference_period", ["id"]).select("id", *keys, "value")


@query(
    "w2_latest_value",
    f"""WITH {model.PUBLISHED_SQL} SELECT id, municipality_ibge_code, indicator_code, value FROM published WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY municipality_ibge_code, indicator_code ORDER BY reference_period DESC, id) = 1""",
)
def latest_value(spark, folder):
    return bench.latest_values(model.published(spark, folder)).select("id", "municipality_ibge_code", "indicator_code", "value")


@query(
    "w5_upsert",
    """SELECT o_custkey AS key, o_orderkey AS id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def upsert_rows(spark, folder):
    current = model.table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("id"))
    incoming = model.table(spark, folder, "orders")
    return upsert(current, incoming.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id")), ["key"], ["id"])


@query(
    "w6_competition_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, score, CAST(rank() OVER (ORDER BY score DESC) AS BIGINT) AS rank
FROM (SELECT *, l_quantity * 2 + l_linenumber / 100000000000.0 AS score FROM lineitem)""",
)
def competition_rank(spark, folder):
    """Few scores over all line items, so that every score is a large tie; some differ in the eleventh place only."""
    rows = model.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 2 + F.col("l_linenumber") / F.lit(100000000000.0)).alias("score")
    )
    return index.competition_rank(rows, F.col("score"))


DETAIL_SQL = f"""{SCORED_SQL}, full_catalog AS (
  SELECT i.indicator_code, i.dimension_code, i.score_direction, i.checklist_max, b.minimum_value, b.maximum_value
  FROM indicators i LEFT JOIN benchmarks b USING (indicator_code)),
all_newest AS (
  SELECT * FROM published QUALIFY row_number() OVER (PARTITION BY municipality_ibge_code, indicator_code ORDER BY reference_period DESC, id) = 1),
detail AS (
  SELECT m.municipality_ibge_code, c.*, n.value, n.reference_period, CASE WHEN n.value IS NULL THEN NULL
    WHEN score_direction = 'checklist' THEN least(100.0, greatest(0.0, n.value / checklist_max * 100))
    WHEN score_direction = 'direct' THEN least(100.0, greatest(0.0, (n.value - minimum_value) / (maximum_value - minimum_value) * 100))
    WHEN score_direction = 'inverse' THEN least(100.0, greatest(0.0, (maximum_value - n.value) / (maximum_value - minimum_value) * 100)) END AS score
  FROM (SELECT DISTINCT municipality_ibge_code FROM published) m CROSS JOIN full_catalog c
  LEFT JOIN all_newest n ON n.municipality_ibge_code = m.municipality_ibge_code AND n.indicator_code = c.indicator_code),
summary AS (
  SELECT municipality_ibge_code, dimension_code, avg(score) AS dimension_score, count(score) AS scored_indicators,
    count(value) AS observed_indicators, count(*) AS total_indicators FROM detail GROUP BY 1, 2)"""


def _detail(spark, folder, codes=None):
    return index.diagnosis(model.published(spark, folder), *_catalogs(spark), codes)


@query(
    "a1_diagnosis",
    f"""WITH {DETAIL_SQL} SELECT municipality_ibge_code, indicator_code, dimension_code, value, CAST(reference_period AS VARCHAR) AS reference_period,
  round(score, 6) AS score FROM detail""",
)
def diagnosis(spark, folder):
    return _detail(spark, folder).select(
        "municipality_ibge_code", "indicator_code", "dimension_code", "value", F.col("reference_period").cast("string").alias("reference_period"),
        F.round("score", 6).alias("score"),
    )


@query(
    "a1_dimension_summary",
    f"""WITH {DETAIL_SQL} SELECT municipality_ibge_code, dimension_code, round(dimension_score, 6) AS dimension_score, scored_indicators,
  observed_indicators, total_indicators FROM summary""",
)
def dimension_summary(spark, folder):
    detail = _detail(spark, folder)
    return index.diagnosis_summary(detail, model.dimensions(spark)).withColumn("dimension_score", F.round("dimension_score", 6))


@query(
    "a16_strongest_and_weakest",
    f"""WITH {DETAIL_SQL}, present AS (SELECT *, dimension_score AS s FROM summary)
SELECT municipality_ibge_code, first(dimension_code ORDER BY s DESC, dimension_code) FILTER (WHERE s IS NOT NULL) AS strongest_dimension,
  CASE WHEN count(s) > 1 THEN first(dimension_code ORDER BY s, dimension_code DESC) FILTER (WHERE s IS NOT NULL) END AS weakest_dimension,
  CAST(sum(total_indicators - observed_indicators) AS BIGINT) AS missing_indicators FROM present GROUP BY 1""",
)
def strongest_and_weakest(spark, folder):
    summary = index.diagnosis_summary(_detail(spark, folder), model.dimensions(spark))
    return index.strongest_and_weakest(summary)


PAGE_COLUMNS = ["rank", "municipality_ibge_code", "name", "scored_indicators"]


@query(
    "a3_ranking_by_dimension",
    f"""WITH {SCORED_SQL}, by_eco AS (SELECT *, rank() OVER (ORDER BY eco_score DESC) AS rank FROM ranked WHERE eco_score IS NOT NULL)
SELECT CAST(rank AS BIGINT) AS rank, municipality_ibge_code, name, scored_indicators FROM by_eco
ORDER BY rank, lower(name), municipality_ibge_code LIMIT 40 OFFSET 20""",
)
def ranking_by_dimension(spark, folder):
    return index.ranking_page(_ranked(spark, folder), "eco", limit=40, offset=20).select(*PAGE_COLUMNS)


@query(
    "a3_ranking_by_coverage",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (ORDER BY overall_score DESC) AS rank FROM ranked)
SELECT CAST(rank AS BIGINT) AS rank, municipality_ibge_code, name, scored_indicators FROM r
ORDER BY scored_indicators, rank, lower(name), municipality_ibge_code LIMIT 100""",
)
def ranking_by_coverage(spark, folder):
    return index.ranking_page(_ranked(spark, folder), sort="coverage", descending=False, limit=100).select(*PAGE_COLUMNS)


@query(
    "a3_ranking_by_missing_dimension",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (ORDER BY overall_score DESC) AS rank FROM ranked)
SELECT CAST(rank AS BIGINT) AS rank, municipality_ibge_code, name, scored_indicators FROM r
ORDER BY pes_score DESC NULLS LAST, rank, lower(name), municipality_ibge_code LIMIT 1000""",
)
def ranking_by_other_dimension(spark, folder):
    return index.ranking_page(_ranked(spark, folder), sort="pes", limit=1000).select(*PAGE_COLUMNS)


@query(
    "f9_ranking_search",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (ORDER BY overall_score DESC) AS rank FROM ranked)
SELECT CAST(rank AS BIGINT) AS rank, municipality_ibge_code, name, scored_indicators FROM r
WHERE contains(lower(name || ' ' || coalesce(state, '') || ' ' || municipality_ibge_code), 'nation_1 0')""",
)
def ranking_search(spark, folder):
    return index.ranking_matches(_ranked(spark, folder), search="  Nátion_1 0").select(*PAGE_COLUMNS)


@query(
    "a3_ranking_ascending",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (ORDER BY overall_score DESC) AS rank FROM ranked)
SELECT CAST(rank AS BIGINT) AS rank, municipality_ibge_code, name, scored_indicators FROM r
ORDER BY overall_score, lower(name) DESC, municipality_ibge_code DESC LIMIT 2500""",
)
def ranking_ascending(spark, folder):
    """The ranking from its end; equal scores come in reverse too."""
    return index.ranking_page(_ranked(spark, folder), descending=False, limit=2500).select(*PAGE_COLUMNS)


@query(
    "a3_ranking_totals",
    f"""WITH {SCORED_SQL} SELECT count(*) AS scored_municipalities,
  count(*) FILTER (contains(lower(name || ' ' || coalesce(state, '') || ' ' || municipality_ibge_code), '7')) AS total FROM ranked""",
)
def ranking_totals(spark, folder):
    return index.ranking_totals(_ranked(spark, folder), search="7")


@query(
    "a3_seek_page",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (ORDER BY overall_score DESC) AS rank FROM ranked)
SELECT CAST(rank AS BIGINT) AS rank, municipality_ibge_code, name, scored_indicators FROM r ORDER BY rank, lower(name), municipality_ibge_code LIMIT 40 OFFSET 60""",
)
def seek_ranking_page(spark, folder):
    """The ranking is written in order once; a page reads the ranges that hold it."""
    ranked = index.ranking_matches(_ranked(spark, folder)).select(*PAGE_COLUMNS, "score")
    book = pages.pages_of_ranking(ranked, "score", search_key(F.col("name")), "municipality_ibge_code", scratch_folder(spark, "ranking-pages"), range_rows=50)
    return book.page(40, 60).drop("score")


@query(
    "a17_seek_page",
    f"""WITH {model.PUBLISHED_SQL} SELECT id, indicator_code, CAST(reference_period AS VARCHAR) AS reference_period FROM published
ORDER BY published.reference_period DESC, id LIMIT 150 OFFSET 1000""",
)
def seek_serving_page(spark, folder):
    """The page after the last row of the page before it, by that row's keys."""
    rows = model.published(spark, folder).select("id", "indicator_code", "reference_period")
    book = pages.pages_of_serving(rows, scratch_folder(spark, "serving-pages"), range_rows=400)
    last = book.page(1, 999).select((-F.unix_date("reference_period")).alias("_k_period"), F.col("id").alias("_k_id")).first()
    return book.after(last.asDict(), 150).withColumn("reference_period", F.col("reference_period").cast("string"))


CODES = ["0000077", "0000033", "0001011"]


@query(
    "a4_compare",
    f"""WITH {DETAIL_SQL} SELECT municipality_ibge_code, indicator_code, value, round(score, 6) AS score,
  CASE municipality_ibge_code WHEN '{CODES[0]}' THEN 1 WHEN '{CODES[1]}' THEN 2 ELSE 3 END AS place
FROM detail WHERE municipality_ibge_code IN ('{"', '".join(CODES)}')""",
)
def compare(spark, folder):
    rows = index.compare(_detail(spark, folder, CODES), [CODES[0], *CODES])
    return rows.select("municipality_ibge_code", "indicator_code", "value", F.round("score", 6).alias("score"), "place")


@query(
    "r5_comparison_table",
    f"""WITH {DETAIL_SQL} SELECT dimension_code, indicator_code, {", ".join(f"round(max(score) FILTER (WHERE municipality_ibge_code = '{c}'), 6) AS score_{c}, max(value) FILTER (WHERE municipality_ibge_code = '{c}') AS value_{c}" for c in CODES)}
FROM detail WHERE municipality_ibge_code IN ('{"', '".join(CODES)}') GROUP BY 1, 2""",
)
def comparison_table(spark, folder):
    wide = index.comparison_table(_detail(spark, folder, CODES), CODES)
    parts = [p for c in CODES for p in (F.round(f"`{c}_score`", 6).alias(f"score_{c}"), F.col(f"`{c}_value`").alias(f"value_{c}"))]
    return wide.select("dimension_code", "indicator_code", *parts)


@query(
    "r6_best_in_row",
    f"""WITH {SCORED_SQL} SELECT municipality_ibge_code, indicator_code, state, coalesce(count(score) OVER w >= 2
  AND min(score) OVER w < max(score) OVER w AND score = max(score) OVER w, false) AS is_best
FROM scored LEFT JOIN municipality ON ibge_code = municipality_ibge_code WINDOW w AS (PARTITION BY indicator_code, state)""",
)
def best_in_row(spark, folder):
    """Best municipality of each state per indicator."""
    scored = index.score_latest(model.published(spark, folder), *_catalogs(spark), model.CODE_PATTERN)
    named = index.with_place_names(scored, model.municipality(spark, folder))
    return index.best_in_row(named, ["indicator_code", "state"]).select("municipality_ibge_code", "indicator_code", "state", "is_best")


@query(
    "a5_indicator_summary",
    f"""WITH {model.PUBLISHED_SQL} SELECT municipality_ibge_code, indicator_code, indicator_name, unit, count(*) AS observations,
  CAST(min(reference_period) AS VARCHAR) AS first_period, CAST(max(reference_period) AS VARCHAR) AS last_period FROM published GROUP BY 1, 2, 3, 4""",
)
def indicator_summary(spark, folder):
    rows = series.indicator_summary(model.published(spark, folder))
    return rows.withColumn("first_period", F.col("first_period").cast("string")).withColumn("last_period", F.col("last_period").cast("string"))


@query(
    "a6_indicator_series",
    f"""WITH {model.PUBLISHED_SQL} SELECT id, CAST(reference_period AS VARCHAR) AS reference_period, value, unit, source_name, import_id FROM published
WHERE municipality_ibge_code = '0000077' AND indicator_code = 'eco01_urgent' ORDER BY published.reference_period, id""",
)
def indicator_series(spark, folder):
    rows = series.indicator_series(model.published(spark, folder), "0000077", "eco01_urgent")
    return rows.select("id", F.col("reference_period").cast("string").alias("reference_period"), "value", "unit", "source_name", "import_id")


@query(
    "a7_series_summary",
    f"""WITH {model.PUBLISHED_SQL}, s AS (
  SELECT municipality_ibge_code, indicator_code, count(*) AS points, first(value ORDER BY reference_period, id) AS first_value,
    first(value ORDER BY reference_period DESC, id DESC) AS last_value, min(value) AS min_value, max(value) AS max_value,
    CAST(first(reference_period ORDER BY value, reference_period) AS VARCHAR) AS min_period,
    CAST(first(reference_period ORDER BY value DESC, reference_period) AS VARCHAR) AS max_period
  FROM published WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT *, round(last_value - first_value, 4) AS change, round((last_value - first_value) / abs(nullif(first_value, 0)) * 100, 6) AS change_percent FROM s""",
)
def series_summary(spark, folder):
    rows = series.series_summary(model.published(spark, folder), ["municipality_ibge_code", "indicator_code"])
    return rows.select(
        "municipality_ibge_code", "indicator_code", "points", "first_value", "last_value", "min_value", "max_value",
        F.col("min_period").cast("string").alias("min_period"), F.col("max_period").cast("string").alias("max_period"),
        F.round("change", 4).alias("change"), F.round("change_percent", 6).alias("change_percent"),
    )


@query(
    "p10_series_labels",
    f"""WITH {model.PUBLISHED_SQL}, flagged AS (
  SELECT *, CASE WHEN import_id = 'P' THEN NULL WHEN import_id = 'F' THEN 'year' ELSE 'month' END AS g FROM published),
kinds AS (SELECT municipality_ibge_code, indicator_code, CASE WHEN bool_or(coalesce(g = 'month', false)) THEN true WHEN count(g) > 0 THEN false
  ELSE bool_or(month(reference_period) <> 1) END AS monthly FROM flagged GROUP BY 1, 2)
SELECT id, CASE WHEN monthly THEN (['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'])[month(reference_period)] || '. de ' || year(reference_period)
  ELSE CAST(year(reference_period) AS VARCHAR) END AS label FROM flagged JOIN kinds USING (municipality_ibge_code, indicator_code) WHERE value IS NOT NULL""",
)
def series_labels(spark, folder):
    flag = F.when(F.col("import_id") == "F", "year").when(F.col("import_id") == "O", "month")
    rows = model.published(spark, folder).withColumn("period_granularity", flag)
    return series.labelled_points(rows, ["municipality_ibge_code", "indicator_code"]).select("id", "label")


@query(
    "a17_serving_page",
    f"""WITH {model.PUBLISHED_SQL}, {model.MUNICIPALITY_SQL} SELECT id, CAST(reference_period AS VARCHAR) AS reference_period, name || ' (' || state || ')' AS municipality_name
FROM published LEFT JOIN municipality ON ibge_code = municipality_ibge_code ORDER BY published.reference_period DESC, id LIMIT 200 OFFSET 100""",
)
def serving_page(spark, folder):
    page = series.serving_page(model.published(spark, folder), model.municipality(spark, folder), 200, 100)
    return page.select("id", F.col("reference_period").cast("string").alias("reference_period"), "municipality_name")


@query("a17_total_rows", f"WITH {model.PUBLISHED_SQL} SELECT count(*) AS total FROM published WHERE starts_with(indicator_code, 'eco')")
def total_rows(spark, folder):
    return series.total_rows(filters.serving_rows(model.published(spark, folder), dimension="eco"))


YEARS = (1994, 1996, 1997, 1998)


def _yearly_population(spark, folder):
    """Population by year: customers in all years but one; a lone row in the newest year."""
    base = model.population(spark, folder)
    years = base.select(F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year"), "*")
    lone = base.filter(F.col("ibge_code") == "0000011").select(F.lit(1999).alias("year"), "*")
    return years.withColumn("inhabitants", F.col("inhabitants") + F.col("year")).unionByName(lone)


@query(
    "a11_municipality_profiles",
    f"""WITH {model.POPULATION_SQL}, shifted AS (SELECT ibge_code AS municipality_ibge_code, inhabitants + 1998 AS inhabitants FROM population)
SELECT municipality_ibge_code, inhabitants, 1998 AS population_year, CASE WHEN inhabitants <= 50000 THEN 'pequeno' WHEN inhabitants <= 300000 THEN 'medio'
  WHEN inhabitants <= 1000000 THEN 'grande' ELSE 'metropole' END AS city_profile FROM shifted WHERE (SELECT count(*) FROM shifted) >= 1000""",
)
def municipality_profiles(spark, folder):
    return bench.municipality_profiles(_yearly_population(spark, folder), 1999)


@query("s13_population_rows", f"WITH {model.POPULATION_SQL} SELECT ibge_code, inhabitants FROM population WHERE inhabitants >= 1000")
def population_rows(spark, folder):
    """Statistics rows with unusable codes and values among them."""
    base = model.population(spark, folder)
    value = F.when(F.col("inhabitants") < 1000, F.lit("...")).otherwise(F.col("inhabitants").cast("string"))
    raw = base.select(F.col("ibge_code").alias("D1C"), value.alias("V"))
    return geography.population_from_rows(raw.unionByName(base.select(F.left("ibge_code", F.lit(2)).alias("D1C"), F.lit("7").alias("V"))))


def _number_sql(value: str) -> str:
    """A score of six places as a report prints it: decimal comma, no zeros at the end."""
    text = f"regexp_replace(regexp_replace(printf('%.6f', {value}), '0+$', ''), '[.]$', '')"
    return f"coalesce(replace({text}, '.', ','), '')"


def _six_places(df, *columns):
    """Scores as the SQL twin can print them; the report itself prints all places."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "s11_ranking_report",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (ORDER BY eco_score DESC) AS rank FROM ranked WHERE eco_score IS NOT NULL)
SELECT rank || ';' || municipality_ibge_code || ';' || name || ';' || coalesce(state, '') || ';' || {_number_sql("eco_score")} || ';' || {_number_sql("overall_score")} || ';'
  || maturity || ';' || {_number_sql("eco_score")} || ';' || {_number_sql("pes_score")} || ';' || ';' || scored_indicators || ';' || observed_indicators AS line FROM r
UNION ALL SELECT 'Posição;Código IBGE;Município;UF;Nota Economia;Nota geral;Nível de maturidade;Nota Economia;Nota Pessoas;Nota Governança;Indicadores com nota;Indicadores com valor'""",
)
def ranking_report(spark, folder):
    """The whole report of the ranking by one dimension, with its header."""
    ranked = index.ranking_matches(_ranked(spark, folder), "eco")
    shown = _six_places(ranked, "score", "overall_score").withColumn("dimension_scores", F.transform_values("dimension_scores", lambda _, v: F.round(v, 6)))
    report = reports.ranking_report(shown, [(code, name) for code, name, *_ in model.DIMENSIONS], "Economia")
    header = spark.createDataFrame([(reports.header_line(report.columns),)], "line string")
    return reports.report_lines(report.toDF(*[f"c{i}" for i in range(len(report.columns))])).unionByName(header)


@query(
    "s11_series_report",
    f"""WITH {model.PUBLISHED_SQL}, {model.MUNICIPALITY_SQL}
SELECT municipality_ibge_code || ';' || coalesce(name, municipality_ibge_code) || ';' || coalesce(state, '') || ';' || indicator_name || ';' || CAST(reference_period AS VARCHAR) || ';'
  || coalesce(regexp_replace(regexp_replace(replace(printf('%.2f', value), '.', ','), '0$', ''), ',0$', ''), '') || ';R$;' || source_name || ';Pedidos ' || import_id AS line
FROM published LEFT JOIN municipality ON ibge_code = municipality_ibge_code""",
)
def series_report(spark, folder):
    named = index.with_place_names(model.published(spark, folder), model.municipality(spark, folder))
    return reports.report_lines(reports.series_report(named.withColumn("import_title", F.concat(F.lit("Pedidos "), "import_id"))))


def _triple_sql(value: str, period: str, score: str) -> str:
    own = lambda column, code: f"max({column}) FILTER (WHERE municipality_ibge_code = '{code}')"
    parts = []
    for code in CODES[:2]:
        cents = f"regexp_replace(regexp_replace(printf('%.2f', {own(value, code)}), '0+$', ''), '[.]$', '')"
        parts += [f"coalesce(replace({cents}, '.', ','), '')", f"coalesce(CAST({own(period, code)} AS VARCHAR), '')", _number_sql(own(score, code))]
    return " || ';' || ".join(parts)


@query(
    "s11_comparison_report",
    f"""WITH {DETAIL_SQL}, chosen AS (SELECT * FROM detail WHERE municipality_ibge_code IN ('{CODES[0]}', '{CODES[1]}')),
lines AS (
  SELECT 1 AS a, display_order AS b, indicator_name AS c, dimension_name || ';' || indicator_name || ';R$;' || {_triple_sql("value", "reference_period", "score")} AS line
  FROM chosen JOIN dimensions USING (dimension_code) JOIN indicators USING (indicator_code) GROUP BY dimension_name, display_order, indicator_name
  UNION ALL SELECT 1, display_order, '', dimension_name || ';Nota da dimensão;;' || {_triple_sql("CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)", "dimension_score")}
  FROM summary JOIN dimensions USING (dimension_code) WHERE municipality_ibge_code IN ('{CODES[0]}', '{CODES[1]}') GROUP BY dimension_name, display_order
  UNION ALL SELECT 0, 0, '', 'Nota geral;;;' || {_triple_sql("CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)", "overall_score")}
  FROM overall WHERE municipality_ibge_code IN ('{CODES[0]}', '{CODES[1]}'))
SELECT row_number() OVER (ORDER BY a, b, c) AS place, line FROM lines""",
)
def comparison_report(spark, folder):
    """The whole lines of the report, in their order."""
    codes = CODES[:2]
    names = model.indicators(spark).select("indicator_code", "indicator_name")
    detail = _detail(spark, folder, codes).drop("indicator_name").join(names, "indicator_code").withColumn("unit", F.lit("R$"))
    summary = index.diagnosis_summary(detail, model.dimensions(spark))
    overall = index.overall_scores(summary, model.dimensions(spark))
    shown = [_six_places(df, c) for df, c in ((detail, "score"), (summary, "dimension_score"), (overall, "overall_score"))]
    report = reports.comparison_report(*shown, model.dimensions(spark), codes, {})
    order = [F.row_number().over(Window.orderBy("_1", "_2", "_3", "_4")).cast("long").alias("place")]  # the lines of one report
    placed = report.select(*order, *[c for c in report.columns if not c.startswith("_")])
    lines = reports.report_lines(placed).select(F.split("line", ";", 2).alias("p"))
    return lines.select(F.col("p")[0].cast("long").alias("place"), F.col("p")[1].alias("line"))


_RANKED_PART = SCORED_SQL[SCORED_SQL.index("catalog AS (") :]
FILE_SQL = f"""{RESOLVED_SQL}, {model.POPULATION_SQL}, {model.DIMENSIONS_SQL}, valued AS (
  SELECT import_id, sheet_name, row_number, municipality_code, CAST(date_trunc('month', strptime(data, '%d/%m/%Y')) AS DATE) AS reference_period,
    CASE WHEN valor <> 's/d' THEN CAST(replace(replace(valor, '.', ''), ',', '.') AS DOUBLE) END AS price, CAST(quantidade AS DOUBLE) AS amount FROM resolved),
measured AS (
  SELECT *, 'eco01_price' AS indicator_code, price AS value FROM valued
  UNION ALL SELECT *, 'pes01_unit', round(price / amount, 10) FROM valued),
single AS (
  SELECT *, count(*) OVER (PARTITION BY import_id, indicator_code, municipality_code, reference_period) AS n FROM measured
  WHERE municipality_code IS NOT NULL AND value IS NOT NULL),
published AS (
  SELECT import_id || '-' || sheet_name || '-' || row_number AS id, indicator_code, reference_period, municipality_code AS municipality_ibge_code, value
  FROM single WHERE n = 1),
per_place AS (
  SELECT p.*, CASE WHEN inhabitants IS NULL OR inhabitants <= 0 THEN NULL WHEN inhabitants <= 50000 THEN 'pequeno' WHEN inhabitants <= 300000 THEN 'medio' ELSE 'larger' END AS profile
  FROM published p LEFT JOIN population ON ibge_code = municipality_ibge_code
  QUALIFY row_number() OVER (PARTITION BY indicator_code, municipality_ibge_code ORDER BY reference_period DESC, id) = 1),
own AS (
  SELECT indicator_code, round(quantile_cont(value, 0.1), 4) AS lo, round(quantile_cont(value, 0.9), 4) AS hi FROM per_place WHERE profile = 'medio'
  GROUP BY 1 HAVING count(*) >= 30 AND quantile_cont(value, 0.1) < quantile_cont(value, 0.9)),
whole AS (
  SELECT indicator_code, round(quantile_cont(value, 0.1), 4) AS lo, round(quantile_cont(value, 0.9), 4) AS hi FROM per_place
  GROUP BY 1 HAVING count(*) >= 30 AND quantile_cont(value, 0.1) < quantile_cont(value, 0.9)),
benchmarks AS (SELECT indicator_code, coalesce(o.lo, w.lo) AS minimum_value, coalesce(o.hi, w.hi) AS maximum_value FROM whole w LEFT JOIN own o USING (indicator_code)),
indicators(indicator_code, dimension_code, score_direction, checklist_max) AS (VALUES ('eco01_price', 'eco', 'direct', NULL), ('pes01_unit', 'pes', 'inverse', NULL)),
{_RANKED_PART}"""


@query(
    "file_to_ranking",
    f"""WITH {FILE_SQL} SELECT CAST(rank() OVER (ORDER BY overall_score DESC) AS BIGINT) AS rank, municipality_ibge_code, name, state,
  round(overall_score, 6) AS overall_score, maturity FROM ranked""",
)
def file_to_ranking(spark, folder):
    """From staged text rows to a ranking: prepare, validate, publish, derive ranges, score, rank.

    The observations and the ranges are written to the shared folder, as a service would keep them.
    """
    municipalities = model.municipality(spark, folder)
    selection = PeriodSelection("date_column", "month", date_field="data")
    mappings = [
        IndicatorMapping("eco01_price", "R$", value_field="valor"),
        IndicatorMapping("pes01_unit", "R$", "ratio", numerator_field="valor", denominator_field="quantidade"),
    ]
    prepared = preparation.prepare_batch(model.staged(spark, folder), selection, mappings, "municipio", municipalities)
    candidates = publication.prepared_candidates(prepared)
    none = publication.empty(spark, publication.OBSERVATION), publication.empty(spark, publication.ISSUE)
    approval = publication.approve(candidates, *none, F.lit("2024-06-01").cast("timestamp"))
    published = materialise(
        approval.observations.select(
            F.concat_ws("-", "import_id", "source_sheet", "source_row_number").alias("id"), "indicator_code", "reference_period",
            F.col("municipality_code").alias("municipality_ibge_code"), F.col("value").cast("double").alias("value"),
        ),
        "published",
    )
    indicators = spark.createDataFrame(
        [("eco01_price", "Price", "eco", "direct", None), ("pes01_unit", "Unit price", "pes", "inverse", None)],
        model.indicators(spark).schema,
    )
    automatic = bench.automatic_benchmarks(published, model.population(spark, folder), indicators)
    ranges = materialise(bench.as_profile_catalog(automatic, "medio"), "ranges")
    ranked = index.rank_municipalities(published, indicators, model.dimensions(spark), ranges, municipalities)
    rows = index.competition_rank(ranked, F.col("overall_score"))
    return rows.select("rank", "municipality_ibge_code", "name", "state", F.round("overall_score", 6).alias("overall_score"), "maturity")
