"""Geography, filter and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civigrade.functions.text import STATES, parse_place_name
from civigrade.operators import filters, geography, search_index
from civigrade.operators.filters import RowFilter
from civigrade.operators.joins import spread
from civigrade.plans import model
from civigrade.plans.registry import Registry
from civigrade.session import materialise, scratch_folder

query = Registry()

STAGED_KEY = ["import_id", "sheet_name", "row_number"]
PREFIX_SQL = """prefixes AS (
  SELECT left(ibge_code, 6) AS prefix, min(ibge_code) AS ibge_code FROM municipality GROUP BY 1 HAVING count(*) = 1)"""
RESOLVED_SQL = f"""{model.STAGED_SQL}, {model.MUNICIPALITY_SQL}, {PREFIX_SQL}, coded AS (
  SELECT *, regexp_replace(trim(municipio), '\\.0+$', '') AS code_text FROM staged),
resolved AS (
  SELECT c.*, coalesce(m.ibge_code, p.ibge_code) AS municipality_code FROM coded c
  LEFT JOIN municipality m ON m.ibge_code = c.code_text LEFT JOIN prefixes p ON p.prefix = c.code_text)"""


@query(
    "g3_resolve_codes",
    f"WITH {RESOLVED_SQL} SELECT import_id, sheet_name, row_number, municipio, municipality_code FROM resolved",
)
def resolve_codes(spark, folder):
    staged = model.staged(spark, folder).withColumn("municipio", F.try_element_at("raw_row", F.lit("municipio")))
    return geography.resolve_codes(staged, F.col("municipio"), model.municipality(spark, folder)).select(
        *STAGED_KEY, "municipio", "municipality_code"
    )


def _places(spark, folder):
    """A catalog whose names repeat across states: part names, state from the brand number."""
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    states = F.array(*[F.lit(s) for s in STATES])
    return model.table(spark, folder, "part").select(
        F.concat(F.format_string("%06d", "p_partkey"), F.lit("7")).alias("ibge_code"),
        F.initcap("p_name").alias("name"), F.element_at(states, number % 27 + 1).alias("state"),
    )


PLACES_SQL = f"""places AS (
  SELECT printf('%06d', p_partkey) || '7' AS ibge_code,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
    ([{', '.join(f"'{s}'" for s in STATES)}])[CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 27 + 1] AS state FROM part)"""


def _spelled_places(spark, folder):
    """Line items naming a place: with state in three forms, bare, by code, or blank."""
    places = _places(spark, folder).withColumnRenamed("ibge_code", "code").withColumn("l_partkey", F.col("code").substr(1, 6).cast("long"))
    line = F.col("l_linenumber")
    spelled = (
        F.when(line == 1, F.concat("name", F.lit(" ("), "state", F.lit(")")))
        .when(line == 2, F.concat(F.lower("state"), F.lit("-"), "name"))
        .when(line == 3, F.concat(F.upper("name"), F.lit(" / "), "state"))
        .when(line == 4, F.col("name"))
        .when(line == 5, F.concat("code", F.lit(".0")))
        .when(line == 6, F.col("code").substr(1, 6))
        .otherwise(F.lit("  "))
    )
    rows = spread(model.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"))
    return rows.join(places, "l_partkey").select(
        (F.col("l_orderkey") * 10 + line).alias("row_number"), "l_partkey", spelled.alias("cell")
    )


SPELLED_SQL = f"""{PLACES_SQL}, spelled AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_number, l_partkey, CASE l_linenumber WHEN 1 THEN name || ' (' || state || ')'
    WHEN 2 THEN lower(state) || '-' || name WHEN 3 THEN upper(name) || ' / ' || state WHEN 4 THEN name
    WHEN 5 THEN ibge_code || '.0' WHEN 6 THEN left(ibge_code, 6) ELSE '' END AS original_name,
    CASE l_linenumber WHEN 1 THEN name || '|' || state WHEN 2 THEN name || '|' || state WHEN 3 THEN upper(name) || '|' || state END AS name_and_state
  FROM lineitem JOIN places ON l_partkey = CAST(left(ibge_code, 6) AS BIGINT))"""
PARSED_SQL = f"{SPELLED_SQL}, parsed AS (SELECT * FROM spelled)"


@query("g2_parse_place_names", f"""WITH {PARSED_SQL} SELECT row_number, l_partkey, split_part(name_and_state, '|', 1) AS name,
  split_part(name_and_state, '|', 2) AS state FROM parsed""")
def parse_place_names(spark, folder):
    parsed = parse_place_name(F.col("cell"))
    return _spelled_places(spark, folder).select("row_number", "l_partkey", parsed["name"].alias("name"), parsed["state"].alias("state"))


KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
MATCHED_SQL = f"""{PARSED_SQL}, keyed AS (
  SELECT *, regexp_replace(original_name, '\\.0+$', '') AS code_text, CASE
    WHEN name_and_state IS NOT NULL THEN 's|' || {KEY.format("split_part(name_and_state, '|', 1)")} || '|' || split_part(name_and_state, '|', 2)
    WHEN regexp_full_match(code_text, '[0-9]{{6,7}}') THEN 'c|' || code_text
    ELSE 'n|' || {KEY.format('original_name')} END AS name_key FROM parsed),
keys AS (
  SELECT 's|' || {KEY.format('name')} || '|' || state AS name_key, * FROM places
  UNION ALL SELECT 'n|' || {KEY.format('name')}, * FROM places
  UNION ALL SELECT 'c|' || ibge_code, * FROM places UNION ALL SELECT 'c|' || left(ibge_code, 6), * FROM places),
counted AS (SELECT name_key, count(*) AS n, min(ibge_code) AS ibge_code FROM keys GROUP BY 1),
matched AS (
  SELECT k.*, CASE WHEN original_name = '' OR c.n IS NULL THEN 'unmatched' WHEN left(k.name_key, 1) = 'n' THEN 'ambiguous'
    WHEN c.n = 1 THEN 'matched' WHEN left(k.name_key, 1) = 's' THEN 'ambiguous' ELSE 'unmatched' END AS status,
    c.n, c.ibge_code FROM keyed k LEFT JOIN counted c ON c.name_key = k.name_key)"""


def _matches(spark, folder):
    return geography.match_names(_spelled_places(spark, folder), F.col("cell"), _places(spark, folder))


def _stored_matches(spark, folder):
    return materialise(_matches(spark, folder), "matches")


@query(
    "g4_match_names",
    f"""WITH {MATCHED_SQL} SELECT row_number, l_partkey, original_name, status, CASE WHEN status = 'matched' THEN ibge_code END AS suggested_code,
  CASE WHEN status = 'ambiguous' THEN n ELSE 0 END AS candidate_count FROM matched""",
)
def match_names(spark, folder):
    return _matches(spark, folder).select(
        "row_number", "l_partkey", "original_name", "status", F.col("suggestion")["ibge_code"].alias("suggested_code"), "candidate_count"
    )


@query(
    "g4_candidates",
    f"""WITH {MATCHED_SQL}, texts AS (SELECT DISTINCT original_name, name_key FROM matched WHERE status = 'ambiguous')
SELECT original_name, ibge_code, name, state FROM texts JOIN keys USING (name_key)""",
)
def candidates(spark, folder):
    return geography.candidates_of(_matches(spark, folder), _places(spark, folder))


GROUPS_SQL = f"""{MATCHED_SQL}, groups AS (
  SELECT original_name, min(status) AS status, min(CASE WHEN status = 'matched' THEN ibge_code END) AS suggested_code, count(*) AS rows
  FROM matched WHERE original_name <> '' GROUP BY 1)"""


@query("g5_group_matches", f"WITH {GROUPS_SQL} SELECT original_name, status, suggested_code, rows FROM groups")
def group_matches(spark, folder):
    groups = geography.group_matches(_matches(spark, folder))
    return groups.select("original_name", "status", F.col("suggestion")["ibge_code"].alias("suggested_code"), "rows")


@query("g5_blank_names", f"WITH {SPELLED_SQL} SELECT count(*) AS blank_rows FROM spelled WHERE original_name = ''")
def blank_names(spark, folder):
    return geography.blank_names(_spelled_places(spark, folder).withColumn("original_name", F.trim("cell")))


def _decisions(spark, folder):
    """Decide every bare name for its first municipality by code."""
    places = _places(spark, folder)
    first = places.groupBy("name").agg(F.min("ibge_code").alias("ibge_code"))
    return first.select(F.col("name").alias("original_name"), "ibge_code", F.lit("candidate").alias("origin"))


CONFIRMED_SQL = f"""{GROUPS_SQL}, decisions AS (SELECT name AS original_name, min(ibge_code) AS decided FROM places GROUP BY 1),
confirmed AS (
  SELECT m.row_number, m.l_partkey, coalesce(d.decided, g.suggested_code) AS chosen_code,
    CASE WHEN d.decided IS NULL OR d.decided = g.suggested_code THEN 'exact' ELSE 'candidate' END AS origin
  FROM matched m JOIN groups g USING (original_name) LEFT JOIN decisions d USING (original_name)
  WHERE coalesce(d.decided, g.suggested_code) IS NOT NULL)"""


@query(
    "g6_confirmed_matches",
    f"WITH {CONFIRMED_SQL} SELECT row_number, chosen_code AS ibge_code, origin FROM confirmed",
)
def confirmed_matches(spark, folder):
    matches = _stored_matches(spark, folder)
    decided = geography.decide(geography.group_matches(matches), _decisions(spark, folder))
    return geography.confirmed_matches(matches, decided)


def _sheet_matches(spark, folder):
    """One sheet: the first spelling of every part as its rows."""
    rows = _spelled_places(spark, folder).groupBy("row_number").agg(F.min("cell").alias("cell"))
    return geography.match_names(rows, F.col("cell"), _places(spark, folder))


ONE_ROW_SQL = MATCHED_SQL.replace("spelled AS (", "all_spelled AS (", 1).replace(
    ", parsed AS (",
    """, spelled AS (
  SELECT row_number, trim(min(CASE WHEN original_name = '' THEN '  ' ELSE original_name END)) AS original_name,
    (arg_min({'v': name_and_state}, CASE WHEN original_name = '' THEN '  ' ELSE original_name END)).v AS name_and_state
  FROM all_spelled GROUP BY 1), parsed AS (""",
    1,
)


@query(
    "g7_check_matches",
    f"""WITH {ONE_ROW_SQL}, sent AS (
  SELECT row_number, CASE WHEN status = 'matched' THEN ibge_code ELSE '0000000' END AS code, status FROM matched WHERE original_name <> '')
SELECT row_number, 'unknown code' AS problem FROM sent WHERE code NOT IN (SELECT ibge_code FROM places)
UNION ALL SELECT row_number, 'does not match the name' FROM sent WHERE status <> 'matched'""",
)
def check_matches(spark, folder):
    # Four checks read the matches: they are worked out once.
    matches = materialise(_sheet_matches(spark, folder), "sheet-matches")
    sent = matches.filter(F.col("original_name") != "").select(
        "row_number", F.coalesce(F.col("suggestion")["ibge_code"], F.lit("0000000")).alias("ibge_code"), F.lit("exact").alias("origin")
    )
    return geography.check_matches(sent, matches, _places(spark, folder))


@query(
    "g7_apply_matches",
    f"""WITH {ONE_ROW_SQL} SELECT row_number, CASE WHEN status = 'matched' THEN ibge_code END AS code,
  CASE WHEN status = 'matched' THEN 'ibge_lookup' END AS source FROM matched""",
)
def apply_matches(spark, folder):
    matches = _sheet_matches(spark, folder)
    earlier = F.create_map(
        F.lit(geography.CODE_FIELD), F.lit("9999999"), F.lit(geography.CODE_SOURCE_FIELD), F.lit(geography.LOOKUP_SOURCE)
    )
    staged = matches.select("row_number", earlier.alias("normalized_row"))
    confirmed = matches.filter(F.col("status") == "matched").select(
        "row_number", F.col("suggestion")["ibge_code"].alias("ibge_code"), F.lit("exact").alias("origin")
    )
    return geography.apply_matches(staged, confirmed).select(
        "row_number", F.try_element_at("normalized_row", F.lit(geography.CODE_FIELD)).alias("code"),
        F.try_element_at("normalized_row", F.lit(geography.CODE_SOURCE_FIELD)).alias("source"),
    )


@query(
    "g8_search_catalog",
    f"""WITH {PLACES_SQL} SELECT ibge_code, name, state FROM places WHERE contains(lower(name), 're')
ORDER BY NOT starts_with(lower(name), 're'), name, state, ibge_code LIMIT 50""",
)
def search_catalog(spark, folder):
    return geography.search_catalog(_places(spark, folder), " RÉ ", 50)


@query(
    "g8_search_by_code",
    f"WITH {PLACES_SQL} SELECT ibge_code, name, state FROM places WHERE starts_with(ibge_code, '0001') ORDER BY ibge_code LIMIT 20",
)
def search_by_code(spark, folder):
    return geography.search_catalog(_places(spark, folder), "0001", 20)


@query(
    "g9_search_registered",
    f"WITH {model.MUNICIPALITY_SQL} SELECT * FROM municipality WHERE ibge_code ILIKE '%012%' OR name ILIKE '%012%' ORDER BY name, ibge_code LIMIT 20",
)
def search_registered(spark, folder):
    return geography.search_registered(model.municipality(spark, folder), " 012 ")


def _code_number(rows):
    return rows.withColumn("_code", F.col("ibge_code").cast("long"))


@query(
    "g8_indexed_search",
    f"""WITH {PLACES_SQL} SELECT ibge_code, name, state FROM places WHERE contains(lower(name), 'red')
ORDER BY NOT starts_with(lower(name), 'red'), name, state, ibge_code LIMIT 50""",
)
def indexed_search(spark, folder):
    """The catalog is indexed once; the search reads the postings of its grams and the ranges that have hits."""
    index = search_index.build(_code_number(_places(spark, folder)), search_index.place_text(), "_code", scratch_folder(spark, "place-index"))
    return search_index.search_places(index, " RÉD ", 50).drop("_code")


@query(
    "g9_indexed_search",
    f"WITH {model.MUNICIPALITY_SQL} SELECT * FROM municipality WHERE ibge_code ILIKE '%0_12%' OR name ILIKE '%0_12%' ORDER BY name, ibge_code LIMIT 20",
)
def indexed_registered(spark, folder):
    """Two characters only, around a wildcard."""
    index = search_index.build(_code_number(model.municipality(spark, folder)), search_index.registered_text(), "_code", scratch_folder(spark, "place-index"))
    return search_index.search_registered(index, " 0_12 ").drop("_code")


@query(
    "g10_register",
    f"""WITH {model.MUNICIPALITY_SQL}, incoming AS (
  SELECT lpad(CAST(s_suppkey * 2 AS VARCHAR), 6, '0') || CAST(s_suppkey * 2 % 10 AS VARCHAR) AS ibge_code, s_name AS name, 'SP' AS state FROM supplier)
SELECT * FROM incoming UNION ALL SELECT * FROM municipality WHERE ibge_code NOT IN (SELECT ibge_code FROM incoming)""",
)
def register(spark, folder):
    incoming = model.table(spark, folder, "supplier").select(
        model.municipality_code(F.col("s_suppkey") * 2).alias("ibge_code"), F.col("s_name").alias("name"), F.lit("SP").alias("state")
    )
    return geography.register(model.municipality(spark, folder), incoming)


def _filter_query(filters_list, keep=None):
    def run(spark, folder):
        return filters.filter_staged(model.staged(spark, folder), filters_list, keep).select(*STAGED_KEY)

    return run


def _filter_sql(condition: str) -> str:
    return f"WITH {model.STAGED_SQL} SELECT import_id, sheet_name, row_number FROM staged WHERE {condition}"


query("f1_equal_and_not_equal", _filter_sql("lower(quantidade) = '12' AND lower(valor) <> 's/d'"))(
    _filter_query([RowFilter("quantidade", "eq", " 12 "), RowFilter("valor", "neq", "S/D")])
)
query("f2_contains", _filter_sql("contains(lower(data), '/03/')"))(_filter_query([RowFilter("data", "contains", "/03/")]))
query("f3_in_list", _filter_sql("desconto IN ('1%', '4%', '10%')"))(_filter_query([RowFilter("desconto", "in", "1%; 4% ;;10%")]))
query(
    "f4_f5_number_range",
    _filter_sql("CAST(quantidade AS INTEGER) >= 10 AND CAST(quantidade AS INTEGER) <= 20 AND NOT contains(valor, 's')"),
)(_filter_query([RowFilter("quantidade", "gte", "10"), RowFilter("quantidade", "lte", "20,0"), RowFilter("valor", "neq", "s/d")]))
query(
    "f6_keep_latest_number",
    f"""WITH {model.STAGED_SQL}, kept AS (SELECT *, CAST(quantidade AS INTEGER) AS q FROM staged WHERE valor <> 's/d')
SELECT import_id, sheet_name, row_number FROM kept WHERE q = (SELECT max(q) FROM kept)""",
)(_filter_query([RowFilter("valor", "neq", "s/d")], "quantidade"))
query(
    "f6_keep_latest_text",
    f"WITH {model.STAGED_SQL} SELECT import_id, sheet_name, row_number FROM staged WHERE data = (SELECT max(data) FROM staged)",
)(_filter_query([], "data"))


@query(
    "f7_filter_counts",
    f"""WITH {model.STAGED_SQL} SELECT import_id, sheet_name, count(*) AS total_rows, count(*) FILTER (WHERE CAST(quantidade AS INTEGER) >= 40) AS kept_rows,
  count(*) FILTER (WHERE CAST(quantidade AS INTEGER) < 40) AS removed_rows FROM staged GROUP BY 1, 2""",
)
def filter_counts(spark, folder):
    staged = model.staged(spark, folder)
    return filters.filter_counts(staged, filters.filter_staged(staged, [RowFilter("quantidade", "gte", "40")]))


@query(
    "f8_serving_filters",
    f"""WITH {model.PUBLISHED_SQL} SELECT id, indicator_code, CAST(reference_period AS VARCHAR) AS reference_period FROM published
WHERE starts_with(indicator_code, 'eco') AND reference_period BETWEEN DATE '1996-02-01' AND DATE '1998-12-31'
  AND (indicator_code ILIKE '%HIGH%' OR indicator_name ILIKE '%HIGH%')""",
)
def serving_filters(spark, folder):
    rows = filters.serving_rows(
        model.published(spark, folder), dimension="Economia", period_from="1996-02", period_to="1998", search='HIGH"'
    )
    return rows.select("id", "indicator_code", F.col("reference_period").cast("string").alias("reference_period"))


@query(
    "f10_search_catalog_rows",
    """SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1
  WHEN starts_with(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), 'red') THEN 2 ELSE 3 END AS INTEGER) AS match_rank
FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'g')""",
)
def search_rows(spark, folder):
    found = filters.search_catalog_rows(model.table(spark, folder, "part"), "Réd  G", ("p_name", "p_brand", "p_type"))
    return found.select("p_partkey", "match_rank")


@query(
    "f10_indexed_search",
    """SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1
  WHEN starts_with(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), 'red') THEN 2 ELSE 3 END AS INTEGER) AS match_rank
FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'br')""",
)
def indexed_rows(spark, folder):
    """A word and a beginning of two letters, looked up in an index over all parts."""
    fields = ("p_name", "p_brand", "p_type")
    index = search_index.build(model.table(spark, folder, "part"), search_index.catalog_text(fields), "p_partkey", scratch_folder(spark, "part-index"))
    return search_index.search_rows(index, "Réd  BR", fields).select("p_partkey", "match_rank")
