"""Queries on column expressions: numbers, scores, text, periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from civigrade.functions import periods, scoring, text, values
from civigrade.functions.periods import PeriodSelection
from civigrade.operators.filters import RowFilter, apply_filters
from civigrade.plans import model
from civigrade.plans.registry import Registry

query = Registry()


def _number_cells(spark, folder):
    """Line items with an amount spelled seven ways."""
    amount, line = F.col("l_extendedprice"), F.col("l_linenumber")
    whole = F.col("l_quantity").cast("int").cast("string")
    spelled = (
        F.when(line == 1, model.br_text(amount))
        .when(line == 2, F.format_number(amount, 2))
        .when(line == 3, F.concat(F.lit(" "), F.format_number(amount, 2), F.lit("%")))
        .when(line == 4, F.concat(whole, F.lit(",500")))
        .when(line == 5, F.concat(whole, F.lit("e2")))
        .when(line == 6, F.concat(F.lit("-"), whole, F.lit(",5%")))
        .otherwise(F.concat(F.lit("n/"), whole))
    )
    return model.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", spelled.alias("cell"))


CELLS_SQL = """cells AS (
  SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber
    WHEN 1 THEN translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
    WHEN 2 THEN format('{:,.2f}', l_extendedprice)
    WHEN 3 THEN ' ' || format('{:,.2f}', l_extendedprice) || '%'
    WHEN 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',500'
    WHEN 5 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'e2'
    WHEN 6 THEN '-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',5%'
    ELSE 'n/' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS cell
  FROM lineitem)"""
BR_SQL = r"regexp_full_match(t, '-?[0-9]{1,3}([.][0-9]{3})+(,[0-9]+)?|-?[0-9]+,[0-9]+')"
US_SQL = r"regexp_full_match(t, '-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?')"
KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]


@query(
    "v1_parse_number",
    rf"""WITH {CELLS_SQL}, bare AS (
  SELECT *, regexp_replace(replace(trim(cell), ' ', ''), '%$', '') AS t FROM cells)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN {BR_SQL} THEN try_cast(replace(replace(t, '.', ''), ',', '.') AS DOUBLE)
  WHEN {US_SQL} THEN try_cast(replace(t, ',', '') AS DOUBLE)
  WHEN regexp_full_match(t, '-?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?') THEN try_cast(t AS DOUBLE) END, 6) AS number FROM bare""",
)
def parse_number(spark, folder):
    cells = _number_cells(spark, folder)
    return cells.select(*KEYS, F.round(values.parse_number(F.col("cell")).cast("double"), 6).alias("number"))


@query(
    "v2_parse_number_us_first",
    rf"""WITH {CELLS_SQL}, bare AS (SELECT *, regexp_replace(cell, '[\s%]', '', 'g') AS t FROM cells)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN {US_SQL} THEN try_cast(replace(t, ',', '') AS DOUBLE)
  WHEN {BR_SQL} THEN try_cast(replace(replace(t, '.', ''), ',', '.') AS DOUBLE)
  WHEN regexp_full_match(t, '-?([0-9]*[.])?[0-9]+') THEN try_cast(t AS DOUBLE) END, 6) AS number FROM bare""",
)
def parse_number_us_first(spark, folder):
    cells = _number_cells(spark, folder)
    return cells.select(*KEYS, F.round(values.parse_number_us_first(F.col("cell")).cast("double"), 6).alias("number"))


@query(
    "v3_parse_wide_number",
    rf"""WITH {CELLS_SQL}, bare AS (SELECT *, trim(cell) AS t, rtrim(trim(cell), '%') AS b FROM cells)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE
  WHEN regexp_full_match(t, '-?[0-9]{{1,3}}([.][0-9]{{3}})+(,[0-9]+)?%?|-?[0-9]+,[0-9]+%?') THEN try_cast(replace(replace(b, '.', ''), ',', '.') AS DOUBLE)
  WHEN regexp_full_match(t, '-?[0-9]+([.][0-9]+)?%?') THEN try_cast(b AS DOUBLE) END, 6) AS number FROM bare""",
)
def parse_wide_number(spark, folder):
    cells = _number_cells(spark, folder)
    return cells.select(*KEYS, F.round(values.parse_wide_number(F.col("cell")).cast("double"), 6).alias("number"))


EXACT_CELL = """CASE l_linenumber % 3 WHEN 0 THEN '9' || lpad(CAST(l_orderkey AS VARCHAR), 30, '0')
  WHEN 1 THEN '1.' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(l_orderkey AS VARCHAR), 15, '0') || '1%'
  ELSE '-' || CAST(l_partkey * 1000 + 1 AS VARCHAR) || 'e-15' END"""


@query(
    "v1_exact_numbers",
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '9' || lpad(CAST(l_orderkey AS VARCHAR), 30, '0')
  WHEN 1 THEN '1' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(l_orderkey AS VARCHAR), 15, '0') || '1'
  ELSE '-0.' || lpad(CAST(l_partkey * 1000 + 1 AS VARCHAR), 15, '0') END AS exact, false AS fits FROM lineitem""",
)
def exact_numbers(spark, folder):
    """Numbers of 31 whole digits, of 16 decimals and of 1e-15: all digits stay, and that a stored number cannot hold them is told."""
    cells = model.table(spark, folder, "lineitem").selectExpr(*KEYS, f"{EXACT_CELL.replace('AS VARCHAR', 'AS STRING')} AS cell")
    exact = values.exact_number(F.col("cell"))
    return cells.select(*KEYS, exact.alias("exact"), values.fits(exact).alias("fits"))


@query("f4_f5_exact_range", "SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 50 AND 150")
def exact_range(spark, folder):
    """Bounds that differ in the twelfth decimal."""
    rows = model.table(spark, folder, "part").select("p_partkey", "p_name", F.concat(F.col("p_partkey").cast("string"), F.lit("e-12")).alias("cell"))
    bounds = [RowFilter("cell", "gte", "0,00000000005"), RowFilter("cell", "lte", "150E-12")]
    return apply_filters(rows, bounds).drop("cell")


@query(
    "v4_v5_numeric_cells",
    rf"""WITH {CELLS_SQL}, bare AS (SELECT *, replace(trim(cell), ' ', '') AS g, replace(trim(cell), ',', '.') AS f FROM cells),
plain AS (SELECT *, CASE WHEN contains(g, ',') AND contains(g, '.') AND length(g) - instr(reverse(g), ',') > length(g) - instr(reverse(g), '.')
    THEN replace(replace(g, '.', ''), ',', '.')
    WHEN contains(g, ',') AND contains(g, '.') THEN replace(g, ',', '') ELSE replace(g, ',', '.') END AS n FROM bare)
SELECT l_orderkey, l_partkey, l_linenumber,
  regexp_full_match(n, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AS is_numeric,
  CASE WHEN regexp_full_match(f, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN round(try_cast(f AS DOUBLE), 6) END AS filter_number
FROM plain""",
)
def numeric_cells(spark, folder):
    cell = F.col("cell")
    return _number_cells(spark, folder).select(
        *KEYS, values.looks_numeric(cell).alias("is_numeric"), F.round(values.filter_number(cell).cast("double"), 6).alias("filter_number")
    )


@query(
    "v6_cell_text",
    """SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity_text,
  coalesce(CASE WHEN l_tax = 0 THEN NULL ELSE trim('  ' || l_returnflag || ' ') END, '') AS flag_text FROM lineitem""",
)
def cell_text(spark, folder):
    flag = F.when(F.col("l_tax") != 0, F.concat(F.lit(" \t"), "l_returnflag", F.lit(" ")))
    return model.table(spark, folder, "lineitem").select(
        *KEYS, text.number_cell_text(F.col("l_quantity")).alias("quantity_text"), text.cell_text(flag).alias("flag_text")
    )


@query(
    "v8_v10_ratio_clamp",
    """SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice / nullif(l_tax, 0) * 0.07, 6) AS per_tax,
  round(least(40000.0, greatest(5000.0, l_extendedprice)), 6) AS limited FROM lineitem""",
)
def ratio_and_clamp(spark, folder):
    price = F.col("l_extendedprice")
    return model.table(spark, folder, "lineitem").select(
        *KEYS, F.round(values.ratio(price, F.col("l_tax"), 0.07), 6).alias("per_tax"), F.round(values.clamp(price, 5000.0, 40000.0), 6).alias("limited")
    )


@query(
    "v11_v12_scores",
    f"""WITH {model.PUBLISHED_SQL}, {model.BENCHMARKS_SQL}, scored AS (
  SELECT id, CASE WHEN value IS NULL THEN NULL
    WHEN score_direction = 'checklist' THEN least(100.0, greatest(0.0, value / checklist_max * 100))
    WHEN score_direction = 'direct' THEN least(100.0, greatest(0.0, (value - minimum_value) / (maximum_value - minimum_value) * 100))
    WHEN score_direction = 'inverse' THEN least(100.0, greatest(0.0, (maximum_value - value) / (maximum_value - minimum_value) * 100)) END AS s
  FROM published JOIN indicators USING (indicator_code) LEFT JOIN benchmarks USING (indicator_code))
SELECT id, round(s, 6) AS score, CASE WHEN s <= 20 THEN 'Nível 1 - Inicial' WHEN s <= 40 THEN 'Nível 2 - Em desenvolvimento'
  WHEN s <= 60 THEN 'Nível 3 - Estruturado' WHEN s <= 80 THEN 'Nível 4 - Gerenciado' WHEN s <= 100 THEN 'Nível 5 - Otimizado' END AS maturity
FROM scored""",
)
def scores(spark, folder):
    catalog = F.broadcast(
        model.indicators(spark).drop("indicator_name").join(model.benchmarks(spark), "indicator_code", "left")
    )  # five literal rows
    rows = model.published(spark, folder).join(catalog, "indicator_code")
    score = scoring.indicator_score(
        F.col("value"), F.col("score_direction"), F.col("minimum_value"), F.col("maximum_value"), F.col("checklist_max")
    )
    return rows.withColumn("s", score).select("id", F.round("s", 6).alias("score"), scoring.maturity(F.col("s")).alias("maturity"))


@query(
    "v13_city_profile",
    f"""WITH {model.POPULATION_SQL} SELECT ibge_code, CASE WHEN inhabitants <= 0 THEN NULL WHEN inhabitants <= 50000 THEN 'pequeno'
  WHEN inhabitants <= 300000 THEN 'medio' WHEN inhabitants <= 1000000 THEN 'grande' ELSE 'metropole' END AS city_profile FROM population""",
)
def city_profile(spark, folder):
    return model.population(spark, folder).select("ibge_code", scoring.city_profile(F.col("inhabitants")).alias("city_profile"))


@query(
    "v14_g1_text_keys",
    """SELECT doc_id, md5(replace(lower(strip_accents(text)), 'ß', 'ss')) AS search_key,
  md5(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))) AS place_key FROM documents""",
)
def text_keys(spark, folder):
    body = F.col("text")
    return model.table(spark, folder, "documents").select(
        "doc_id", F.md5(text.search_key(body)).alias("search_key"), F.md5(text.place_name_key(body)).alias("place_key")
    )


@query(
    "v15_short_codes",
    f"""WITH {model.PUBLISHED_SQL} SELECT id, upper(coalesce(nullif(regexp_extract(indicator_code, '^([a-zA-Z]{{3}}[0-9]{{2}})_', 1), ''), indicator_code)) AS short_code,
  upper(coalesce(nullif(regexp_extract(import_id, '^([a-zA-Z]{{3}}[0-9]{{2}})_', 1), ''), import_id)) AS other_code FROM published""",
)
def short_codes(spark, folder):
    return model.published(spark, folder).select(
        "id", text.short_code(F.col("indicator_code")).alias("short_code"), text.short_code(F.col("import_id")).alias("other_code")
    )


@query(
    "v16_dimension_prefix",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'eco' WHEN 'view' THEN 'pes' WHEN 'purchase' THEN 'gov'
  WHEN 'signup' THEN 'qvi' END AS prefix FROM events""",
)
def dimension_prefix(spark, folder):
    kind = F.col("event_type")
    spelled = (
        F.when(kind == "click", "Economia").when(kind == "view", " PES ").when(kind == "purchase", "Governança")
        .when(kind == "signup", "qualidade de VIDA").otherwise(kind)
    )
    return model.table(spark, folder, "events").select("event_id", text.dimension_prefix(spelled).alias("prefix"))


@query(
    "v17_v18_json_cells",
    """SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS at, replace(props, ' ', '') AS props,
  CASE WHEN value <> 0 THEN round(1 / value, 4) END AS inverse FROM events""",
)
def json_cells(spark, folder):
    rows = model.table(spark, folder, "events").withColumn("parsed", F.from_json("props", "k int")).withColumn(
        "inverse", F.round(F.lit(1.0) / F.when(F.col("value") != 0, F.col("value")), 4)
    )
    types = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "event_id", text.json_cell(F.col("ts"), types["ts"]).alias("at"), text.json_cell(F.col("parsed"), types["parsed"]).alias("props"),
        text.json_cell(F.col("inverse"), types["inverse"]).cast("double").alias("inverse"),
    )


def _date_cells(spark, folder):
    """Orders with their date spelled per priority; pending low ones have an impossible month."""
    day, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    month_name = F.element_at(F.array(*[F.lit(m) for m in ("Jan", "Fev.", "março", "abr", "MAI", "junho", "jul", "Agosto", "set", "out", "nov", "dezembro")]), F.month(day))
    spelled = (
        F.when(kind == "1-URGENT", F.date_format(day, "yyyy-MM-dd'T'HH:mm"))
        .when(kind == "2-HIGH", F.date_format(day, "dd/MM/yyyy"))
        .when(kind == "3-MEDIUM", F.date_format(day, "MM/yyyy"))
        .when(kind == "4-NOT SPECIFIED", F.concat(month_name, F.lit(" de "), F.year(day).cast("string")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.year(day).cast("string"), F.lit("-13-01")))
        .otherwise(F.date_format(day, "yyyyMM"))
    )
    return model.table(spark, folder, "orders").withColumn("cell", spelled)


@query(
    "p3_date_periods",
    """SELECT o_orderkey, CASE WHEN ok THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN ok THEN CAST(month(o_orderdate) AS INTEGER) END AS month
FROM (SELECT *, NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AS ok FROM orders)""",
)
def date_periods(spark, folder):
    period = periods.parse_date_period(F.col("cell"))
    return _date_cells(spark, folder).select("o_orderkey", period["year"].alias("year"), period["month"].alias("month"))


@query(
    "p1_p2_year_month",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS month FROM orders""",
)
def year_and_month(spark, folder):
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    year = F.year(day).cast("string")
    month = F.month(day).cast("string")
    year_cell = F.when(status == "O", year).when(status == "F", F.concat(year, F.lit(".0"))).otherwise(F.right(year, F.lit(2)))
    name = F.element_at(F.array(*[F.lit(m.upper()) for m in periods.MONTH_NAMES]), F.month(day))
    month_cell = F.when(status == "O", F.concat(month, F.lit(",00"))).when(status == "F", name).otherwise(F.concat(F.lit("x"), month))
    return model.table(spark, folder, "orders").select(
        "o_orderkey", periods.parse_year(year_cell).alias("year"), periods.parse_month(month_cell).alias("month")
    )


@query(
    "p4_row_periods",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year_column, strftime(o_orderdate, '%Y-%m-01') AS month_year_columns,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-01') END AS date_month,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-01-01') END AS date_year,
  '2022-03-01' AS fixed, strftime(o_orderdate, '%Y-01-01') AS prepared FROM orders""",
)
def row_periods(spark, folder):
    rows = _date_cells(spark, folder).withColumns(
        {
            "ano": F.year("o_orderdate").cast("string"),
            "mes": F.month("o_orderdate").cast("string"),
            "reference_year": F.year("o_orderdate").cast("string"),
            "reference_period": F.lit(None).cast("string"),
        }
    )
    start = lambda selection: periods.period_start(periods.row_period(F.col, selection)[0]).cast("string")
    return rows.select(
        "o_orderkey",
        F.year(periods.period_start(periods.row_period(F.col, PeriodSelection("year_column", year_field="ano"))[0])).alias("year_column"),
        start(PeriodSelection("month_year_columns", "month", year_field="ano", month_field="mes")).alias("month_year_columns"),
        start(PeriodSelection("date_column", "month", date_field="cell")).alias("date_month"),
        start(PeriodSelection("date_column", "year", date_field="cell")).alias("date_year"),
        start(PeriodSelection("fixed", "month", fixed_year=2022, fixed_month=3)).alias("fixed"),
        start(PeriodSelection("prepared", "year")).alias("prepared"),
    )


@query(
    "p5_p6_title_periods",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS title_year,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(month(o_orderdate) AS INTEGER) END AS title_month,
  CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) >= 2000 THEN CAST(month(o_orderdate) AS INTEGER) END AS legacy_month FROM orders""",
)
def title_periods(spark, folder):
    day, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    year = F.year(day).cast("string")
    full = F.element_at(F.array(*[F.lit(m) for m in periods.MONTH_NAMES]), F.month(day))
    title = (
        F.when(kind == "1-URGENT", F.upper(F.concat_ws("/", F.replace(full, F.lit("marco"), F.lit("Março")), year, F.lit("Saldos"))))
        .when(kind == "2-HIGH", F.concat_ws(" ", F.lit(" Saldo"), F.left(full, F.lit(3)), year))
        .when(kind == "5-LOW", F.concat(F.lit("primar"), year))
        .otherwise(F.concat(F.lit("Valor "), year))
    )
    period = periods.title_period(title)
    return model.table(spark, folder, "orders").select(
        "o_orderkey", period["year"].alias("title_year"), period["month"].alias("title_month"),
        periods.legacy_month_title(title)["month"].alias("legacy_month"),
    )


@query(
    "p9_effective_granularity",
    """WITH o AS (SELECT o_orderkey, (['year_column', 'month_year_columns', 'prepared', 'date_column', 'fixed'])[o_orderkey % 5 + 1] AS mode,
  CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END AS granularity, CASE o_orderkey % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'year' END AS prepared FROM orders)
SELECT o_orderkey, CASE mode WHEN 'year_column' THEN 'year' WHEN 'month_year_columns' THEN 'month' WHEN 'prepared' THEN coalesce(prepared, 'year') ELSE granularity END AS granularity FROM o""",
)
def effective_granularity(spark, folder):
    key = F.col("o_orderkey")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("year_column", "month_year_columns", "prepared", "date_column", "fixed")]), (key % 5 + 1).cast("int"))
    chosen = F.when(key % 2 == 0, "month").otherwise("year")
    prepared = F.when(key % 3 == 0, "month").when(key % 3 == 1, "year")
    return model.table(spark, folder, "orders").select("o_orderkey", periods.effective_granularity(mode, chosen, prepared).alias("granularity"))


@query(
    "p7_period_bounds",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-01-01') WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-01')
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS lower_bound,
  CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-12-31') WHEN 'F' THEN CAST(last_day(o_orderdate) AS VARCHAR)
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS upper_bound FROM orders""",
)
def period_bounds(spark, folder):
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    cell = F.when(status == "O", F.date_format(day, "yyyy")).when(status == "F", F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return model.table(spark, folder, "orders").select(
        "o_orderkey", periods.period_bound(cell, False).cast("string").alias("lower_bound"), periods.period_bound(cell, True).cast("string").alias("upper_bound")
    )


@query(
    "p9_p11_granularity",
    """SELECT o_orderkey, CASE WHEN day(o_orderdate) = 1 THEN 'month' ELSE 'year' END AS value_granularity,
  CASE o_orderstatus WHEN 'O' THEN 'month' WHEN 'F' THEN 'year' END AS frequency FROM orders""",
)
def granularity(spark, folder):
    status = F.col("o_orderstatus")
    frequency = F.when(status == "O", "Mensal").when(status == "F", " ANUAL").otherwise("eventual")
    return model.table(spark, folder, "orders").select(
        "o_orderkey",
        periods.value_granularity(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("value_granularity"),
        periods.frequency_granularity(frequency).alias("frequency"),
    )
