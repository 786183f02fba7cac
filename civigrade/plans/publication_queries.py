"""Reshape, preparation, publication and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civigrade.functions.values import parse_number
from civigrade.functions.periods import PeriodSelection, month_start_text
from civigrade.operators import benchmarks, delta, ledger, lifecycle, preparation, publication, reshape, tombstones
from civigrade.operators.preparation import IndicatorMapping
from civigrade.operators.reshape import PeriodColumn
from civigrade.plans import model
from civigrade.plans.geography_queries import RESOLVED_SQL
from civigrade.plans.registry import Registry
from civigrade.session import materialise, scratch_folder
from civigrade.sources import tables

query = Registry()

ROW = ["import_id", "sheet_name", "row_number"]
NOW = "2024-06-01 00:00:00"
BY_MONTH = PeriodSelection("date_column", "month", date_field="data")
MAPPINGS = [
    IndicatorMapping("preco", "R$", value_field="valor"),
    IndicatorMapping("quantidade", "un", value_field="quantidade", value_max=40.0),
    IndicatorMapping("preco_unitario", "R$", "ratio", numerator_field="valor", denominator_field="quantidade"),
    IndicatorMapping("preco_por_mil", "R$", "ratio_population", numerator_field="valor", multiplier=1000.0),
]
YEARS = range(1995, 2001)  # no population for the last year of the shipments


def _now():
    return F.lit(NOW).cast("timestamp")


def _population(spark, folder):
    """Yearly population: the base figure grows by 1000 a year."""
    years = F.array(*[F.lit(y) for y in YEARS])
    base = model.population(spark, folder).select("*", F.explode(years).alias("year"))
    return base.withColumn("inhabitants", F.col("inhabitants") + (F.col("year") - YEARS[0]) * 1000)


YEARLY_SQL = f"""yearly AS (
  SELECT ibge_code, y AS year, inhabitants + (y - {YEARS[0]}) * 1000 AS inhabitants
  FROM population, (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS y))"""
PREPARED_SQL = f"""{RESOLVED_SQL}, prepared AS (
  SELECT import_id, sheet_name, row_number, municipality_code, municipio, valor, quantidade,
    strptime(data, '%d/%m/%Y') AS day, CASE WHEN valor <> 's/d' THEN CAST(replace(replace(valor, '.', ''), ',', '.') AS DOUBLE) END AS price,
    CAST(quantidade AS DOUBLE) AS amount FROM resolved)"""


def _single(spark, folder):
    return preparation.prepare_single(
        model.staged(spark, folder), BY_MONTH, "valor", "municipio", model.municipality(spark, folder)
    )


@query(
    "q1_prepare_single",
    f"""WITH {PREPARED_SQL} SELECT import_id, sheet_name, row_number, municipality_code, strftime(day, '%Y-%m-01') AS period, price AS value,
  CASE WHEN municipality_code IS NULL THEN municipio END AS municipality_problem, CASE WHEN price IS NULL THEN valor END AS value_problem FROM prepared""",
)
def prepare_single(spark, folder):
    return _single(spark, folder).select(
        *ROW, "municipality_code", month_start_text(F.col("period")).alias("period"), F.col("value").cast("double").alias("value"),
        "municipality_problem", "value_problem",
    )


@query(
    "q1_problem_rows",
    f"""WITH {PREPARED_SQL} SELECT import_id, sheet_name, row_number, 'municipality' AS kind, municipio AS text FROM prepared WHERE municipality_code IS NULL
UNION ALL SELECT import_id, sheet_name, row_number, 'value', valor FROM prepared WHERE price IS NULL""",
)
def problem_rows(spark, folder):
    return preparation.problem_rows(_single(spark, folder))


def _batch(spark, folder):
    return preparation.prepare_batch(
        model.staged(spark, folder), BY_MONTH, MAPPINGS, "municipio", model.municipality(spark, folder), _population(spark, folder)
    )


BATCH_SQL = f"""{PREPARED_SQL}, {model.POPULATION_SQL}, {YEARLY_SQL}, valued AS (
  SELECT p.*, inhabitants FROM prepared p LEFT JOIN yearly y ON y.year = year(day) AND y.ibge_code = municipality_code),
batch AS (
  SELECT import_id, sheet_name, row_number, municipality_code, day, 'preco' AS indicator_code, price AS value, valor AS source_measure FROM valued
  UNION ALL SELECT import_id, sheet_name, row_number, municipality_code, day, 'quantidade', least(amount, 40), quantidade FROM valued
  UNION ALL SELECT import_id, sheet_name, row_number, municipality_code, day, 'preco_unitario', round(price / amount, 10), valor || ' / ' || quantidade FROM valued
  UNION ALL SELECT import_id, sheet_name, row_number, municipality_code, day, 'preco_por_mil', round(price / nullif(inhabitants, 0) * 1000, 10),
    valor || ' / população ' || CAST(year(day) AS VARCHAR) || ': ' || coalesce(CAST(inhabitants AS VARCHAR), 'sem dado') FROM valued)"""


@query(
    "r4_q2_prepare_batch",
    f"""WITH {BATCH_SQL} SELECT import_id, sheet_name, row_number, indicator_code, municipality_code, strftime(day, '%Y-%m-01') AS period,
  round(value, 8) AS value, source_measure FROM batch""",
)
def prepare_batch(spark, folder):
    return _batch(spark, folder).select(
        *ROW, "indicator_code", "municipality_code", month_start_text(F.col("period")).alias("period"),
        F.round(F.col("value").cast("double"), 8).alias("value"), "source_measure",
    )


@query(
    "q2_problem_counts",
    f"WITH {BATCH_SQL} SELECT import_id, indicator_code, count(*) FILTER (WHERE value IS NULL) AS value_problem_count FROM batch GROUP BY 1, 2",
)
def problem_counts(spark, folder):
    return preparation.batch_problems(_batch(spark, folder))


@query(
    "w8_problem_samples",
    f"""WITH {BATCH_SQL} SELECT import_id, indicator_code, sheet_name, row_number, source_measure FROM batch WHERE value IS NULL
QUALIFY row_number() OVER (PARTITION BY import_id, indicator_code ORDER BY row_number, sheet_name, source_measure) <= 5""",
)
def problem_samples(spark, folder):
    return preparation.batch_problem_samples(_batch(spark, folder))


@query(
    "q2_prepared_cells",
    f"""WITH {PREPARED_SQL} SELECT import_id, sheet_name, row_number, municipality_code AS code, strftime(day, '%Y') AS year,
  strftime(day, '%Y-%m-01') AS period, price, amount FROM prepared""",
)
def prepared_cells(spark, folder):
    rows = preparation.with_prepared_cells(
        model.staged(spark, folder), BY_MONTH, MAPPINGS[:1] + [IndicatorMapping("quantidade", "un", value_field="quantidade")],
        "municipio", model.municipality(spark, folder),
    )
    cell = lambda name: F.try_element_at("normalized_row", F.lit(name))
    return rows.select(
        *ROW, cell(preparation.APPROVAL_CODE_FIELD).alias("code"), cell("reference_year").alias("year"), cell("reference_period").alias("period"),
        cell("value__preco").try_cast("double").alias("price"),
        F.get_json_object(cell("indicator_values"), "$.quantidade").try_cast("double").alias("amount"),
    )


PREVIEW_SQL = f"""{model.STAGED_SQL}, preview AS (
  SELECT *, CASE WHEN valor <> 's/d' THEN CAST(replace(replace(valor, '.', ''), ',', '.') AS DOUBLE) / nullif(CAST(quantidade AS DOUBLE), 0) * 100 END AS v FROM staged)"""


def _preview(spark, folder):
    return preparation.preview_rows(model.staged(spark, folder), "ratio", "", "valor", "quantidade", 100.0)


@query(
    "q3_preview_counts",
    f"""WITH {PREVIEW_SQL} SELECT import_id, count(*) AS total_rows, count(v) AS valid_rows, count(*) - count(v) AS invalid_rows FROM preview GROUP BY 1""",
)
def preview_counts(spark, folder):
    return preparation.preview_counts(_preview(spark, folder))


@query(
    "q4_prepare_ratio",
    f"WITH {PREVIEW_SQL} SELECT import_id, sheet_name, row_number, round(v, 4) AS value, 'ratio' AS calculation_type, '100' AS multiplier FROM preview",
)
def prepare_ratio(spark, folder):
    rows = preparation.prepare_ratio(model.staged(spark, folder), "valor", "quantidade", 100.0)
    cell = lambda name: F.try_element_at("normalized_row", F.lit(name))
    return rows.select(
        *ROW, F.round("value", 4).alias("value"), cell("calculation_type").alias("calculation_type"),
        cell("calculation_multiplier").alias("multiplier"),
    )


@query(
    "q3_preview_examples",
    f"""WITH {PREVIEW_SQL} SELECT row_number, import_id, sheet_name, municipio AS municipality, valor AS numerator, quantidade AS denominator,
  round(v, 4) AS calculated_value FROM preview ORDER BY row_number, import_id, sheet_name LIMIT 10""",
)
def preview_examples(spark, folder):
    return preparation.preview_examples(_preview(spark, folder)).select(
        *ROW, "municipality", "numerator", "denominator", F.round("calculated_value", 4).alias("calculated_value")
    )


# Approval: line items are staged, orders are the observations published earlier.
EARLIER_FILES = {"O": "file A", "F": "file N", "P": "file R"}


def _earlier(spark, folder):
    """Earlier observations of the price: one active row per import, municipality and month; sheet by priority."""
    status, kind = F.col("o_orderstatus"), F.col("o_orderpriority")
    file = F.lit(None).cast("string")
    for key, name in EARLIER_FILES.items():
        file = F.when(status == key, F.lit(name)).otherwise(file)
    sheet = F.when(kind.isin("1-URGENT", "2-HIGH"), "older sheet").when(kind == "3-MEDIUM", "sheet F").otherwise("")
    month = F.trunc("o_orderdate", "month")
    first = model.table(spark, folder, "orders").groupBy(
        file.alias("import_id"), model.municipality_code(F.col("o_custkey")).alias("municipality_code"), month.alias("reference_period")
    ).agg(F.min(F.struct("o_orderkey", "o_totalprice", sheet.alias("sheet"))).alias("o"))
    return first.select(
        "import_id", F.lit("preco").alias("indicator_code"), "municipality_code", F.year("reference_period").alias("reference_year"),
        "reference_period", F.col("o.o_totalprice").cast("decimal(38,10)").alias("value"), F.lit("R$").alias("unit"),
        F.col("o.sheet").alias("source_sheet"), F.col("o.o_orderkey").alias("source_row_number"), F.lit(True).alias("is_monthly"),
        F.lit(None).cast("timestamp").alias("superseded_at"),
    )


EARLIER_SQL = """earlier AS (
  SELECT CASE o_orderstatus WHEN 'O' THEN 'file A' WHEN 'F' THEN 'file N' ELSE 'file R' END AS import_id, 'preco' AS indicator_code,
    printf('%06d', o_custkey) || CAST(o_custkey % 10 AS VARCHAR) AS municipality_code,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_period, o_totalprice AS value, o_orderkey AS source_row_number,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'older sheet' WHEN o_orderpriority = '3-MEDIUM' THEN 'sheet F' ELSE '' END AS source_sheet
  FROM orders QUALIFY row_number() OVER (PARTITION BY import_id, municipality_code, reference_period ORDER BY o_orderkey) = 1)"""


def _price_candidates(spark, folder):
    municipalities = model.municipality(spark, folder)
    prepared = preparation.prepare_batch(model.staged(spark, folder), BY_MONTH, MAPPINGS[:1], "municipio", municipalities)
    return publication.prepared_candidates(prepared)


CANDIDATES_SQL = f"""{PREPARED_SQL}, candidates AS (
  SELECT import_id, 'preco' AS indicator_code, sheet_name, row_number, coalesce(municipality_code, '') AS municipality_code,
    CAST(date_trunc('month', day) AS DATE) AS reference_period, price AS value, municipality_code IS NOT NULL AS valid_municipality,
    price IS NOT NULL AS valid_value, municipality_code IS NOT NULL AND price IS NOT NULL AS is_valid FROM prepared),
marked AS (
  SELECT *, CASE WHEN is_valid THEN count(*) FILTER (WHERE is_valid) OVER (PARTITION BY import_id, municipality_code, reference_period) ELSE 0 END AS duplicate_count
  FROM candidates),
remaining AS (SELECT *, source_sheet IN ('', 'sheet F', 'sheet O') AS is_superseded FROM earlier),
judged AS (
  SELECT m.*, is_valid AND r.source_sheet IS NOT NULL AND r.source_sheet <> m.sheet_name AS is_conflict FROM marked m
  LEFT JOIN (SELECT * FROM remaining WHERE NOT is_superseded) r USING (import_id, indicator_code, municipality_code, reference_period))"""


@query(
    "q5_q6_candidates",
    f"""WITH {EARLIER_SQL}, {CANDIDATES_SQL} SELECT import_id, sheet_name, row_number, municipality_code, CAST(reference_period AS VARCHAR) AS reference_period,
  round(value, 4) AS value, valid_municipality, valid_value, is_valid, duplicate_count FROM marked""",
)
def candidates(spark, folder):
    return publication.mark_duplicates(materialise(_price_candidates(spark, folder), "candidates")).select(
        *ROW, "municipality_code", F.col("reference_period").cast("string").alias("reference_period"),
        F.col("value").cast("double").alias("value"), "valid_municipality", "valid_value", "is_valid", "duplicate_count",
    )


@query(
    "q5_text_candidates",
    f"""WITH {PREPARED_SQL} SELECT import_id, sheet_name, row_number, strftime(day, '%Y') AS year,
  CASE WHEN valor = 's/d' THEN NULL ELSE amount END AS value, municipality_code IS NOT NULL AND regexp_full_match(municipio, '[0-9]{{7}}') AS valid_municipality,
  strftime(day, '%Y-%m-01') AS reference_period FROM prepared""",
)
def text_candidates(spark, folder):
    """Candidates straight from text cells: only full codes, years with a zero fraction and plain numbers count."""
    cell = lambda name: F.try_element_at("raw_row", F.lit(name))
    day = F.to_date(cell("data"), "dd/MM/yyyy")
    staged = model.staged(spark, folder).withColumn(
        "normalized_row",
        F.create_map(
            F.lit("reference_year"), F.concat(F.date_format(day, "yyyy"), F.lit(".0")),
            F.lit("value"), F.when(cell("valor") == "s/d", cell("valor")).otherwise(cell("quantidade")),
            F.lit("reference_period"), F.date_format(day, "yyyy-MM-01"),
        ),
    )
    fields = publication.FieldNames("municipio", "reference_year", "value")
    rows = publication.text_candidates(staged, model.municipality(spark, folder), fields, "quantidade", "un")
    return rows.select(
        *ROW, F.col("reference_year").cast("string").alias("year"), F.col("value").cast("double").alias("value"), "valid_municipality",
        F.col("reference_period").cast("string").alias("reference_period"),
    )


def approve(spark, folder):
    """The whole approval: staged text rows to observations and issues."""
    scope = model.literal_table(
        spark, [(file, "preco", sheet) for file in EARLIER_FILES.values() for sheet in ("sheet F", "sheet O")], *publication.SCOPE
    )
    return publication.approve(
        _price_candidates(spark, folder), _earlier(spark, folder), _earlier_issues(spark, folder), _now(), scope=scope
    )


def _earlier_issues(spark, folder):
    """Issues found earlier: of sheets approved again (replaced) and of another sheet (kept)."""
    names = publication.FieldNames()
    supplier = model.table(spark, folder, "supplier")
    sheet = F.when(F.col("s_acctbal") < 5000, "sheet F").otherwise("older sheet")
    return supplier.select(
        F.lit("file A").alias("import_id"), F.lit("preco").alias("indicator_code"), F.lit("error").alias("severity"),
        F.col("s_suppkey").alias("row_number"), F.lit(names.value).alias("field"),
        F.concat(F.lit('Aba "'), sheet, F.lit('": '), F.lit(publication.MESSAGES["value"])).alias("message"),
    )


def _issue_sql(condition: str, field: str, rule: str) -> str:
    return f"""SELECT import_id, row_number, '{field}' AS field, 'Aba "' || sheet_name || '": {publication.MESSAGES[rule]}' AS message FROM judged WHERE {condition}"""


_CODE_FIELD = publication.FieldNames().municipality


@query(
    "q7_q8_issues",
    f"""WITH {EARLIER_SQL}, {CANDIDATES_SQL}
{_issue_sql("NOT valid_municipality", _CODE_FIELD, "municipality")}
UNION ALL {_issue_sql("NOT valid_value", "value", "value")}
UNION ALL {_issue_sql("duplicate_count > 1", _CODE_FIELD, "duplicate")}
UNION ALL {_issue_sql("is_conflict", _CODE_FIELD, "conflict")}
UNION ALL SELECT 'file A', s_suppkey, 'value', 'Aba "older sheet": {publication.MESSAGES["value"]}' FROM supplier WHERE s_acctbal >= 5000""",
)
def issues(spark, folder):
    return approve(spark, folder).issues.select("import_id", "row_number", "field", "message")


OBSERVATIONS_SQL = f"""{EARLIER_SQL}, {CANDIDATES_SQL}, observations AS (
  SELECT import_id, indicator_code, municipality_code, reference_period, value, source_sheet, source_row_number, is_superseded FROM remaining
  UNION ALL SELECT import_id, indicator_code, municipality_code, reference_period, value, sheet_name, row_number, false FROM judged
  WHERE is_valid AND duplicate_count = 1 AND NOT is_conflict)"""


def _sheetless(spark, folder):
    """Prepared candidates some of which have no sheet, others a sheet with a quote in its name."""
    prepared = preparation.prepare_batch(model.staged(spark, folder), BY_MONTH, MAPPINGS[:1], "municipio", model.municipality(spark, folder))
    sheet = F.when(F.col("row_number") % 3 == 0, F.lit(None)).when(F.col("row_number") % 3 == 1, F.lit('plan "B"')).otherwise(F.col("sheet_name"))
    return publication.prepared_candidates(prepared.withColumn("sheet_name", sheet))


SHEETLESS_SQL = f"""{PREPARED_SQL}, c AS (
  SELECT import_id, row_number, CASE row_number % 3 WHEN 0 THEN NULL WHEN 1 THEN 'plan "B"' ELSE sheet_name END AS sheet_name, municipality_code, price,
    CAST(date_trunc('month', day) AS DATE) AS month FROM prepared),
marked AS (
  SELECT *, municipality_code IS NOT NULL AND price IS NOT NULL AS is_valid,
    CASE WHEN municipality_code IS NOT NULL AND price IS NOT NULL THEN count(*) FILTER (WHERE municipality_code IS NOT NULL AND price IS NOT NULL)
      OVER (PARTITION BY import_id, sheet_name, municipality_code, month) ELSE 0 END AS n FROM c)"""


@query(
    "q6_rows_without_sheet",
    f"""WITH {SHEETLESS_SQL} SELECT import_id, sheet_name, row_number, n AS duplicate_count FROM marked""",
)
def rows_without_sheet(spark, folder):
    """Every candidate is judged within its sheet, also where it has none."""
    marked = publication.mark_duplicates(_sheetless(spark, folder), by_sheet=True)
    return marked.select("import_id", "sheet_name", "row_number", "duplicate_count")


@query(
    "q8_every_candidate_is_told",
    f"""WITH {SHEETLESS_SQL} SELECT import_id, 'published' AS outcome, count(*) AS rows FROM marked WHERE is_valid AND n = 1 GROUP BY 1
UNION ALL SELECT import_id, 'issue', count(DISTINCT row_number) FROM marked WHERE NOT (is_valid AND n = 1) GROUP BY 1""",
)
def every_candidate_is_told(spark, folder):
    """Issues and observations together cover all candidates; issues of an earlier approval of the same sheets are gone."""
    candidates = _sheetless(spark, folder)
    now = F.lit("2024-05-01").cast("timestamp")
    none = publication.empty(spark, publication.OBSERVATION)
    fields = publication.FieldNames()
    stale = candidates.select("import_id", "indicator_code", "sheet_name", "row_number").withColumn("row_number", F.col("row_number") + 1_000_000_000_000)
    message = F.concat(publication.message_prefix(F.col("sheet_name")), F.lit("old"))
    earlier = stale.select("import_id", "indicator_code", F.lit("error").alias("severity"), "row_number", F.lit(fields.value).alias("field"), message.alias("message"))
    done = publication.approve(candidates, none, earlier, now, fields, by_sheet=True)
    published = done.observations.select("import_id", "source_row_number", F.lit("published").alias("outcome"))
    told = done.issues.select("import_id", "row_number", F.lit("issue")).distinct()
    return published.union(told).groupBy("import_id", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "q2_mapping_problems",
    "SELECT 'preco' AS indicator_code, 'unknown indicator' AS problem UNION ALL SELECT 'p1', 'inactive indicator' FROM part WHERE p_partkey = 1 AND p_size <= 50",
)
def mapping_problems(spark, folder):
    """Mappings checked against a catalog with one indicator per part, of which the first is inactive."""
    key = F.col("p_partkey")
    catalog = model.table(spark, folder, "part").select(F.concat(F.lit("p"), key.cast("string")).alias("indicator_code"), (key != 1).alias("active"))
    mappings = [IndicatorMapping(code, "un", value_field="valor") for code in ("preco", "p1", "p2", "p3")]
    return preparation.mapping_problems(mappings, catalog)


@query(
    "q9_observations",
    f"""WITH {OBSERVATIONS_SQL} SELECT import_id, municipality_code, CAST(reference_period AS VARCHAR) AS reference_period, round(value, 4) AS value,
  source_sheet, source_row_number, is_superseded FROM observations""",
)
def observations(spark, folder):
    return approve(spark, folder).observations.select(
        "import_id", "municipality_code", F.col("reference_period").cast("string").alias("reference_period"),
        F.col("value").cast("double").alias("value"), "source_sheet", "source_row_number", F.col("superseded_at").isNotNull().alias("is_superseded"),
    )


@query(
    "q11_approved_counts",
    f"WITH {OBSERVATIONS_SQL} SELECT import_id, indicator_code, count(*) AS approved_rows FROM observations WHERE NOT is_superseded GROUP BY 1, 2",
)
def approved_counts(spark, folder):
    return publication.approved_counts(approve(spark, folder).observations)


def _earlier_published(spark, folder):
    """What was published from the earlier observations."""
    return _earlier(spark, folder).select(
        F.concat_ws("-", "import_id", F.col("source_row_number").cast("string")).alias("id"), "import_id", F.lit("d1").alias("dataset_id"),
        "indicator_code", F.lit("Preço").alias("indicator_name"), F.col("municipality_code").alias("municipality_ibge_code"),
        "reference_period", "value", "unit", "source_sheet", "source_row_number", "is_monthly", "superseded_at",
    )


def _file_imports(spark):
    return spark.createDataFrame([(f, "d1") for f in EARLIER_FILES.values()], "import_id string, dataset_id string")


def _price_indicator(spark):
    return spark.createDataFrame([("preco", "Preço")], "indicator_code string, indicator_name string")


@query(
    "q10_sync_published",
    f"""WITH {OBSERVATIONS_SQL}, active AS (SELECT * FROM observations WHERE NOT is_superseded)
SELECT import_id, municipality_code AS municipality_ibge_code, CAST(reference_period AS VARCHAR) AS reference_period, 'Preço' AS indicator_name,
  round(CASE WHEN a.import_id IS NOT NULL THEN a.value ELSE e.value END, 4) AS value, e.import_id IS NULL AS is_new, a.import_id IS NULL AS is_superseded
FROM earlier e FULL JOIN active a USING (import_id, municipality_code, reference_period)""",
)
def sync_published(spark, folder):
    after = approve(spark, folder).observations
    rows = publication.sync_published(
        _earlier_published(spark, folder), after, _file_imports(spark), _price_indicator(spark), _now()
    )
    return rows.select(
        "import_id", "municipality_ibge_code", F.col("reference_period").cast("string").alias("reference_period"), "indicator_name",
        F.col("value").cast("double").alias("value"), (F.length("id") == 32).alias("is_new"), F.col("superseded_at").isNotNull().alias("is_superseded"),
    )


# Approval of one import as a change of ledgers.
APPROVED_FILE = "file A"


def _delta_approval(spark, folder):
    """Ledgers of observations and issues after the approval of one import, made twice."""
    sheets = ("sheet F", "sheet O")
    scope = model.literal_table(spark, [(APPROVED_FILE, "preco", sheet) for sheet in sheets], *publication.SCOPE)
    observations = delta.observation_ledger(_earlier(spark, folder), scratch_folder(spark, "observations"))
    issues = delta.issue_ledger(_earlier_issues(spark, folder), scratch_folder(spark, "issues"))
    staged = model.staged(spark, folder).filter(F.col("import_id") == APPROVED_FILE)
    prepared = preparation.prepare_batch(staged, BY_MONTH, MAPPINGS[:1], "municipio", model.municipality(spark, folder))
    candidates = publication.prepared_candidates(prepared)
    for day in ("2024-05-01", "2024-06-01"):
        delta.approve(candidates, observations, issues, F.lit(day).cast("timestamp"), scope)
    return observations, issues


DELTA_SQL = f"""{EARLIER_SQL}, {CANDIDATES_SQL}, observations AS (
  SELECT import_id, municipality_code, reference_period, value, source_sheet, source_row_number, is_superseded AND import_id = '{APPROVED_FILE}' AS is_superseded
  FROM remaining
  UNION ALL SELECT import_id, municipality_code, reference_period, value, sheet_name, row_number, false FROM judged
  WHERE import_id = '{APPROVED_FILE}' AND is_valid AND duplicate_count = 1 AND NOT is_conflict)"""


@query(
    "q9_delta_approval",
    f"""WITH {DELTA_SQL} SELECT import_id, municipality_code, CAST(reference_period AS VARCHAR) AS reference_period, round(value, 4) AS value,
  source_sheet, source_row_number, is_superseded, CASE WHEN is_superseded THEN '2024-05-01' END AS superseded_on FROM observations""",
)
def delta_approval(spark, folder):
    """One import approved twice: only its slot is read and written, and the second time commits nothing."""
    return _delta_approval(spark, folder)[0].read().select(
        "import_id", "municipality_code", F.col("reference_period").cast("string").alias("reference_period"), F.col("value").cast("double").alias("value"),
        "source_sheet", "source_row_number", F.col("superseded_at").isNotNull().alias("is_superseded"),
        F.date_format("superseded_at", "yyyy-MM-dd").alias("superseded_on"),
    )


def _delta_issue_sql(condition: str, field: str, rule: str) -> str:
    return f"{_issue_sql(condition, field, rule)} AND import_id = '{APPROVED_FILE}'"


@query(
    "q8_delta_issues",
    f"""WITH {EARLIER_SQL}, {CANDIDATES_SQL}
{_delta_issue_sql("NOT valid_municipality", _CODE_FIELD, "municipality")}
UNION ALL {_delta_issue_sql("NOT valid_value", "value", "value")}
UNION ALL {_delta_issue_sql("duplicate_count > 1", _CODE_FIELD, "duplicate")}
UNION ALL {_delta_issue_sql("is_conflict", _CODE_FIELD, "conflict")}
UNION ALL SELECT 'file A', s_suppkey, 'value', 'Aba "older sheet": {publication.MESSAGES["value"]}' FROM supplier WHERE s_acctbal >= 5000""",
)
def delta_issues(spark, folder):
    return _delta_approval(spark, folder)[1].read().select("import_id", "row_number", "field", "message")


@query(
    "q10_delta_sync",
    f"""WITH {DELTA_SQL}, active AS (SELECT * FROM observations WHERE NOT is_superseded)
SELECT import_id, municipality_code AS municipality_ibge_code, CAST(reference_period AS VARCHAR) AS reference_period, 'Preço' AS indicator_name,
  round(CASE WHEN a.import_id IS NOT NULL THEN a.value ELSE e.value END, 4) AS value, e.import_id IS NULL AS is_new, a.import_id IS NULL AS is_superseded
FROM earlier e FULL JOIN active a USING (import_id, municipality_code, reference_period)""",
)
def delta_sync(spark, folder):
    """Published values brought up to date with the slots that the approval has changed."""
    observations, _ = _delta_approval(spark, folder)
    published = delta.published_ledger(_earlier_published(spark, folder), scratch_folder(spark, "published"))
    for _ in range(2):
        delta.sync(published, observations, _file_imports(spark), _price_indicator(spark), _now(), since=0)
    return published.read().select(
        "import_id", "municipality_ibge_code", F.col("reference_period").cast("string").alias("reference_period"), "indicator_name",
        F.col("value").cast("double").alias("value"), (F.length("id") == 32).alias("is_new"), F.col("superseded_at").isNotNull().alias("is_superseded"),
    )


@query(
    "w5_delta_upsert",
    """SELECT p_brand, p_partkey, CASE WHEN l.price IS NOT NULL THEN round(l.price, 2) ELSE round(p_retailprice, 2) END AS price, l.price IS NOT NULL AS is_incoming
FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity >= 50 GROUP BY 1) l ON l_partkey = p_partkey AND p_brand = 'Brand#1'""",
)
def delta_upsert(spark, folder):
    """Prices of one brand replaced by those of large sales; the slots of other brands are not touched."""
    part, line = model.table(spark, folder, "part"), model.table(spark, folder, "lineitem")
    rows = part.select("p_brand", "p_partkey", F.col("p_retailprice").alias("price"), F.lit(False).alias("is_incoming"))
    prices = ledger.create(rows, scratch_folder(spark, "prices"), ("p_brand",), ("p_partkey",))
    sold = line.filter("l_quantity >= 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("price"))
    incoming = rows.filter("p_brand = 'Brand#1'").select("p_brand", "p_partkey").join(sold, "p_partkey").withColumn("is_incoming", F.lit(True))
    ledger.upsert_slots(prices, incoming, ["p_brand", "p_partkey"])
    return prices.read().withColumn("price", F.round("price", 2))


# Imports for the life-cycle queries: one per supplier, its rows are the line items.
STATUSES = ("draft", "needs_review", "approved", "archived", "discarded")


def _imports(spark, folder):
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    status = F.element_at(statuses, F.col("s_nationkey") % len(STATUSES) + 1)
    return model.table(spark, folder, "supplier").select(
        F.concat(F.lit("i"), F.col("s_suppkey").cast("string")).alias("import_id"), F.col("s_name").alias("title"), status.alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s_suppkey") * 60).alias("created_at"),
        F.when(status == "approved", F.lit("2024-01-01").cast("timestamp")).alias("approved_at"),
        F.when(status == "archived", F.lit("2024-01-01").cast("timestamp")).alias("archived_at"),
        F.col("s_nationkey").alias("source_id"), F.concat(F.lit("d"), (F.col("s_nationkey") % 7).cast("string")).alias("dataset_id"),
    )


IMPORTS_SQL = f"""imports AS (
  SELECT 'i' || s_suppkey AS import_id, s_name AS title, ([{", ".join(f"'{s}'" for s in STATUSES)}])[s_nationkey % {len(STATUSES)} + 1] AS status,
    s_suppkey, s_nationkey AS source_id, 'd' || (s_nationkey % 7) AS dataset_id FROM supplier)"""


def _facts(spark, folder):
    """Published rows of the imports; returned items are already superseded."""
    return model.table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id"),
        F.concat(F.lit("i"), F.col("l_suppkey").cast("string")).alias("import_id"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 11).cast("string")).alias("dataset_id"),
        F.concat(F.lit("eco0"), F.col("l_linenumber").cast("string"), F.lit("_x")).alias("indicator_code"),
        F.lit("Name").alias("indicator_name"), model.municipality_code(F.col("l_partkey")).alias("municipality_ibge_code"),
        F.trunc("l_shipdate", "month").alias("reference_period"), F.col("l_extendedprice").cast("decimal(38,10)").alias("value"),
        F.lit("R$").alias("unit"), F.lit("s").alias("source_sheet"), F.col("l_orderkey").alias("source_row_number"),
        (F.col("l_linestatus") == "F").alias("is_monthly"),
        F.when(F.col("l_returnflag") == "R", F.lit("2023-01-01").cast("timestamp")).alias("superseded_at"),
    )


@query(
    "q12_status_after_approval",
    f"""WITH {IMPORTS_SQL}, judged AS (SELECT * FROM imports WHERE source_id < 10),
totals AS (SELECT 'i' || l_suppkey AS import_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1)
SELECT i.import_id, CASE WHEN source_id >= 10 THEN status WHEN coalesce(n, 0) > 0 THEN 'approved' ELSE 'needs_review' END AS status
FROM imports i LEFT JOIN totals USING (import_id)""",
)
def status_after_approval(spark, folder):
    imports = _imports(spark, folder)
    judged = imports.filter(F.col("source_id") < 10)
    return publication.set_status(imports, judged, _facts(spark, folder), _now()).select("import_id", "status")


def _import_ids(count: int) -> list[str]:
    return [f"i{n}" for n in range(count)]


def _id_list(count: int) -> str:
    return ", ".join(f"'{i}'" for i in _import_ids(count))


@query(
    "q13_generic_approval",
    f"""WITH {IMPORTS_SQL} SELECT import_id, CASE WHEN import_id = 'i3' THEN 'approved' ELSE status END AS status,
  CASE WHEN import_id = 'i3' THEN '{{"a": "b"}}' END AS mapping FROM imports""",
)
def generic_approval(spark, folder):
    none = publication.empty(spark, "import_id string, mapping string, explanation string, confidence double")
    imports, proposals = publication.approve_generic(_imports(spark, folder), none, "i3", '{"a": "b"}', "because", _now())
    return imports.join(proposals.select("import_id", "mapping"), "import_id", "left").select("import_id", "status", "mapping")


@query(
    "q14_unapprove",
    f"""WITH {IMPORTS_SQL} SELECT l_orderkey * 10 + l_linenumber AS id, import_id, l_returnflag = 'R' OR (status = 'approved' AND import_id IN ({_id_list(40)})) AS is_superseded
FROM lineitem JOIN imports ON l_suppkey = s_suppkey""",
)
def unapprove(spark, folder):
    rows = lifecycle.supersede_import(_facts(spark, folder), _imports(spark, folder), _import_ids(40), _now())
    return rows.select(F.col("id").cast("long").alias("id"), "import_id", F.col("superseded_at").isNotNull().alias("is_superseded"))


@query(
    "q14_withdrawn_counts",
    f"""WITH {IMPORTS_SQL} SELECT import_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS superseded_rows FROM imports
LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE status = 'approved' AND import_id IN ({_id_list(40)}) GROUP BY 1""",
)
def withdrawn_counts(spark, folder):
    return lifecycle.withdrawn_counts(_facts(spark, folder), _imports(spark, folder), _import_ids(40))


@query(
    "q14_q15_status_changes",
    f"""WITH {IMPORTS_SQL} SELECT import_id, CASE WHEN status = 'approved' AND import_id IN ({_id_list(40)}) THEN 'needs_review' ELSE status END AS unapproved,
  CASE WHEN status <> 'discarded' AND import_id IN ({_id_list(40)}) THEN 'archived' ELSE status END AS archived,
  CASE WHEN import_id IN ({_id_list(40)}) THEN 'discarded' ELSE status END AS discarded FROM imports""",
)
def status_changes(spark, folder):
    imports, ids = _imports(spark, folder), _import_ids(40)
    back = lifecycle.unapprove(imports, ids).select("import_id", F.col("status").alias("unapproved"))
    archived = lifecycle.archive(imports, ids, _now()).select("import_id", F.col("status").alias("archived"))
    discarded = lifecycle.discard(imports, ids).select("import_id", F.col("status").alias("discarded"))
    return back.join(archived, "import_id").join(discarded, "import_id")


@query(
    "q16_delete_cascade",
    f"""WITH {IMPORTS_SQL}, gone AS (SELECT * FROM imports WHERE import_id IN ({_id_list(40)})), kept AS (SELECT * FROM imports WHERE import_id NOT IN ({_id_list(40)}))
SELECT 'published_values' AS "table", count(*) AS rows FROM lineitem WHERE 'i' || l_suppkey IN ({_id_list(40)})
UNION ALL SELECT 'imports', count(*) FROM gone
UNION ALL SELECT 'sources', count(*) FROM nation WHERE n_nationkey IN (SELECT source_id FROM gone) AND n_nationkey NOT IN (SELECT source_id FROM kept)""",
)
def delete_cascade(spark, folder):
    sources = model.table(spark, folder, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    *_, counts = lifecycle.delete_cascade(
        {"published_values": _facts(spark, folder)}, _imports(spark, folder), sources, _import_ids(40)
    )
    return counts


FACT_SLOTS = 16


def _fact_tables(spark, folder):
    """The six fact tables of the imports."""
    facts, imports = _facts(spark, folder), _imports(spark, folder)
    line = model.table(spark, folder, "lineitem")
    import_id = F.concat(F.lit("i"), F.col("l_suppkey").cast("string")).alias("import_id")
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number")
    return {
        "published_values": facts,
        "observations": facts.filter("is_monthly").select("import_id", "indicator_code", "municipality_ibge_code", "reference_period", "value", "superseded_at"),
        "validation_issues": line.filter("l_tax = 0").select(import_id, number, F.lit("value").alias("field")),
        "treatment_proposals": imports.select("import_id", "title"),
        "import_rows": line.select(import_id, number, F.col("l_extendedprice").cast("string").alias("raw_text")),
        "import_sheets": line.select(import_id, F.col("l_linestatus").alias("sheet_name")).distinct(),
    }


def _stored_facts(spark, folder):
    """The fact tables as ledgers; each caller gets its own, since it changes them."""
    rows = _fact_tables(spark, folder)
    facts = tombstones.facts_at(spark, scratch_folder(spark, "facts"), {name: df.schema for name, df in rows.items()}, FACT_SLOTS)
    for name, df in rows.items():
        tombstones.put(facts, name, df)
    return facts


def _chosen_imports(spark, count):
    return spark.range(count).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("import_id"))


@query(
    "q14_marked_withdrawal",
    f"""WITH {IMPORTS_SQL} SELECT l_orderkey * 10 + l_linenumber AS id, import_id, l_returnflag = 'R' OR (status = 'approved' AND import_id IN ({_id_list(40)})) AS is_superseded
FROM lineitem JOIN imports ON l_suppkey = s_suppkey""",
)
def marked_withdrawal(spark, folder):
    """Approved ones of the chosen imports are withdrawn by marks; no fact is rewritten."""
    published = _facts(spark, folder)
    facts = tombstones.facts_at(spark, scratch_folder(spark, "facts"), {"published_values": published.schema}, FACT_SLOTS)
    tombstones.put(facts, "published_values", published)
    approved = _imports(spark, folder).filter("status = 'approved'").join(_chosen_imports(spark, 40), "import_id", "left_semi")
    tombstones.withdraw(facts, approved.select("import_id"), _now())
    rows = tombstones.read(facts, "published_values")
    return rows.select(F.col("id").cast("long").alias("id"), "import_id", F.col("superseded_at").isNotNull().alias("is_superseded"))


_FACTS_SQL = """facts AS (
  SELECT 'published_values' AS "table", 'i' || l_suppkey AS import_id, l_returnflag <> 'R' AS active FROM lineitem
  UNION ALL SELECT 'observations', 'i' || l_suppkey, l_returnflag <> 'R' FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT 'validation_issues', 'i' || l_suppkey, true FROM lineitem WHERE l_tax = 0
  UNION ALL SELECT 'treatment_proposals', 'i' || s_suppkey, true FROM supplier
  UNION ALL SELECT 'import_rows', 'i' || l_suppkey, true FROM lineitem
  UNION ALL SELECT 'import_sheets', import_id, true FROM (SELECT DISTINCT 'i' || l_suppkey AS import_id, l_linestatus FROM lineitem))"""


@query(
    "q16_marked_deletion",
    f"""WITH {_FACTS_SQL} SELECT "table", count(*) FILTER (WHERE import_id IN ({_id_list(40)})) AS deleted_rows, count(*) FILTER (WHERE active AND import_id IN ({_id_list(40)})) AS deleted_active,
  count(*) FILTER (WHERE import_id NOT IN ({_id_list(40)})) AS left_rows FROM facts GROUP BY 1""",
)
def marked_deletion(spark, folder):
    """Imports deleted from all six fact tables: counted, marked, and compacted away."""
    facts, gone = _stored_facts(spark, folder), _chosen_imports(spark, 40)
    told = materialise(tombstones.counts(facts, gone).groupBy("table").agg(F.sum("rows").alias("deleted_rows"), F.sum("active").alias("deleted_active")), "told")
    tombstones.delete(facts, gone, _now())
    tombstones.compact(facts)
    left = None
    for name, table in facts.tables.items():
        rows = table.read().agg(F.count(F.lit(1)).alias("left_rows")).withColumn("table", F.lit(name))
        left = rows if left is None else left.unionByName(rows)
    return left.join(told, "table", "left").na.fill(0).select("table", "deleted_rows", "deleted_active", "left_rows")


@query(
    "q17_impact",
    f"""WITH {IMPORTS_SQL} SELECT import_id, title, status, count(l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS published_values, count(l_suppkey) AS import_rows
FROM imports LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def impact(spark, folder):
    facts = _facts(spark, folder)
    tables_by_name = {"published_values": facts.filter(F.col("superseded_at").isNull()), "import_rows": facts}
    return lifecycle.impact(tables_by_name, _imports(spark, folder))


@query(
    "q18_serving_view",
    f"""WITH {IMPORTS_SQL} SELECT l_orderkey * 10 + l_linenumber AS id, import_id, n_name AS source_name, title AS import_title,
  CASE WHEN l_suppkey % 11 < 7 THEN 'data ' || (l_suppkey % 11) END AS dataset_name, CASE WHEN l_suppkey % 11 < 7 AND l_suppkey % 11 % 5 < 4 THEN r_name END AS domain_name,
  CASE WHEN l_linestatus = 'F' THEN 'month' ELSE 'year' END AS period_granularity
FROM lineitem JOIN imports ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = source_id LEFT JOIN region ON r_regionkey = l_suppkey % 11 % 5
WHERE l_returnflag <> 'R' AND status = 'approved'""",
)
def serving_view(spark, folder):
    sources = model.table(spark, folder, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    domains = model.table(spark, folder, "region").select(
        F.when(F.col("r_regionkey") < 4, F.col("r_regionkey")).otherwise(100).alias("domain_id"), F.col("r_name").alias("domain_name")
    )
    datasets = model.table(spark, folder, "nation").select(
        F.concat(F.when(F.col("n_nationkey") < 7, F.lit("d")).otherwise(F.lit("unused ")), F.col("n_nationkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("data "), F.col("n_nationkey").cast("string")).alias("dataset_name"), (F.col("n_nationkey") % 5).alias("domain_id"),
    )
    view = publication.serving_view(_facts(spark, folder), _imports(spark, folder), sources, datasets, domains)
    return view.select(
        F.col("id").cast("long").alias("id"), "import_id", "source_name", "import_title", "dataset_name", "domain_name", "period_granularity"
    )


@query(
    "q19_deactivate_legacy",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN false WHEN p_type = 'ECONOMY' THEN true
  ELSE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'R' AND l_tax = 0) END AS active FROM part""",
)
def deactivate_legacy(spark, folder):
    key = F.col("p_partkey").cast("string")
    code = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("eco01_"), key)).otherwise(F.concat(F.lit("old_"), key))
    indicators = model.table(spark, folder, "part").select("p_partkey", code.alias("indicator_code"), (F.col("p_size") <= 25).alias("active"))
    used = model.table(spark, folder, "lineitem")
    published = used.select(
        F.concat(F.when(F.col("l_tax") == 0, F.lit("old_")).otherwise(F.lit("other_")), F.col("l_partkey").cast("string")).alias("indicator_code"),
        F.when(F.col("l_returnflag") == "R", F.lit("2023-01-01").cast("timestamp")).alias("superseded_at"),
    )
    return lifecycle.deactivate_legacy(indicators, published).select("p_partkey", "active")


@query(
    "s15_list_imports",
    f"WITH {IMPORTS_SQL} SELECT import_id, status FROM imports WHERE status <> 'discarded' ORDER BY s_suppkey DESC LIMIT 50",
)
def list_imports(spark, folder):
    return lifecycle.list_imports(_imports(spark, folder), limit=50).select("import_id", "status")


# Reshape: one wide row per customer with the order total of each year.
WIDE_YEARS = range(1995, 2002)
WIDE_COLUMNS = [PeriodColumn(f"valor_{y}", y) for y in WIDE_YEARS]
MONTHS = ("janeiro", "junho", "dezembro")
MONTH_COLUMNS = [PeriodColumn(f"{m}_1997_saldo", 1997, n) for m, n in zip(MONTHS, (1, 6, 12))]


def _wide(spark, folder):
    day, price = F.col("o_orderdate"), F.col("o_totalprice")
    sums = [F.round(F.sum(F.when(F.year(day) == c.year, price)), 2).alias(c.field) for c in WIDE_COLUMNS]
    sums += [F.round(F.sum(F.when((F.year(day) == 1997) & (F.month(day) == c.month), price)), 2).alias(c.field) for c in MONTH_COLUMNS]
    wide = model.table(spark, folder, "orders").groupBy("o_custkey").agg(*sums)
    code = model.municipality_code(F.col("o_custkey"))
    spelled = F.when(F.col("o_custkey") % 10 == 3, F.left(code, F.lit(6))).when(F.col("o_custkey") % 10 == 4, F.lit("?")).otherwise(code)
    fields = [p for c in WIDE_COLUMNS + MONTH_COLUMNS for p in (F.lit(c.field), model.br_text(F.col(c.field)))]
    return wide.select(
        F.lit("wide").alias("import_id"), F.lit("Dados").alias("sheet_name"), (F.col("o_custkey") + 1).alias("row_number"),
        F.create_map(F.lit("ibge"), spelled, F.lit("uf"), F.lit("SP"), *fields).alias("raw_row"),
        F.create_map(F.lit("value"), F.lit("old"), F.lit("kept"), F.lit("1")).alias("normalized_row"),
    )


_SUMS = ", ".join(
    [f"round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = {c.year}), 2) AS {c.field}" for c in WIDE_COLUMNS]
    + [f"round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = {c.month}), 2) AS {c.field}" for c in MONTH_COLUMNS]
)
WIDE_SQL = f"""{model.MUNICIPALITY_SQL}, wide AS (
  SELECT o_custkey + 1 AS source_row, printf('%06d', o_custkey) || CAST(o_custkey % 10 AS VARCHAR) AS full_code,
    CASE o_custkey % 10 WHEN 3 THEN left(full_code, 6) WHEN 4 THEN '?' ELSE full_code END AS ibge, {_SUMS} FROM orders GROUP BY o_custkey)"""
EXPANDED_SQL = f"""{WIDE_SQL}, long AS (
  {" UNION ALL ".join(f"SELECT source_row, ibge, full_code, {i} AS position, '{c.field}' AS field, {c.year} AS y, {c.month or 'NULL'} AS m, '{c.label}' AS label, {c.field} AS value FROM wide" for i, c in enumerate(WIDE_COLUMNS + MONTH_COLUMNS))}),
expanded AS (
  SELECT row_number() OVER (ORDER BY source_row, position) AS row_number, long.*, CASE WHEN ibge <> '?' THEN full_code END AS municipality_code
  FROM long WHERE value IS NOT NULL)"""


def _expanded(spark, folder):
    columns = WIDE_COLUMNS + MONTH_COLUMNS
    return reshape.expand_periods(
        _wide(spark, folder), columns, "ibge", model.municipality(spark, folder),
        reshape.identity_fields(["ibge", "uf", "valor_1995"], "ibge"), "valor  total",
    )


@query(
    "r1_expand_periods",
    f"""WITH {EXPANDED_SQL} SELECT 'Dados · valor total por período' AS sheet_name, row_number, municipality_code, field AS coluna_original, label AS competencia,
  CAST(source_row AS VARCHAR) AS linha_original, ibge, CAST(y AS VARCHAR) AS reference_year, CASE WHEN m IS NOT NULL THEN label END AS reference_period, round(value, 4) AS value FROM expanded""",
)
def expand_periods(spark, folder):
    raw = lambda name: F.try_element_at("raw_row", F.lit(name))
    prepared = lambda name: F.try_element_at("normalized_row", F.lit(name))
    return _expanded(spark, folder).select(
        "sheet_name", "row_number", prepared("municipality_ibge_code").alias("municipality_code"), raw("coluna_original").alias("coluna_original"),
        raw("competencia").alias("competencia"), raw("linha_original").alias("linha_original"), raw("ibge").alias("ibge"),
        prepared("reference_year").alias("reference_year"), prepared("reference_period").alias("reference_period"),
        F.round(F.col("value").cast("double"), 4).alias("value"),
    )


@query(
    "r1_expansion_counts",
    f"""WITH {EXPANDED_SQL} SELECT 'wide' AS import_id, count(*) AS created_rows, (SELECT count(*) FROM long) - count(*) AS empty_cells,
  count(*) FILTER (WHERE municipality_code IS NULL) AS unresolved_rows FROM expanded""",
)
def expansion_counts(spark, folder):
    return reshape.expansion_counts(_wide(spark, folder), _expanded(spark, folder), len(WIDE_COLUMNS + MONTH_COLUMNS))


def _prepared_sql(column: PeriodColumn, kept: str, raw: bool = False) -> str:
    ready = f"regexp_full_match(ibge, '[0-9]{{7}}') AND {column.field} IS NOT NULL" + (" AND (source_row - 1) % 10 NOT IN (7, 8, 9)" if raw else "")
    return f"""WITH {WIDE_SQL} SELECT source_row AS row_number, {ready} AS is_prepared, CASE WHEN {ready} THEN round({column.field}, 4) END AS value,
  CASE WHEN {ready} THEN '{column.year}' END AS reference_year, {f"CASE WHEN {ready} THEN '{column.label}' END" if column.month else "CAST(NULL AS VARCHAR)"} AS reference_period, {kept} AS kept FROM wide"""


def _prepared(column: PeriodColumn, reset: bool):
    def run(spark, folder):
        wide = _wide(spark, folder)
        if reset:  # percent signs, grouping by commas and exponents are no numbers there
            cell, digit = F.element_at("raw_row", column.field), (F.col("row_number") - 1) % 10
            odd = F.when(digit == 7, F.concat(cell, F.lit("%"))).when(digit == 8, F.lit("1,234.5")).when(digit == 9, F.lit("1e3")).otherwise(cell)
            others = F.map_filter("raw_row", lambda key, _: key != column.field)
            wide = wide.withColumn("raw_row", F.map_concat(others, F.create_map(F.lit(column.field), odd)))
        rows = reshape.prepare_wide_column(wide, column, "ibge", reset)
        cell = lambda name: F.try_element_at("normalized_row", F.lit(name))
        return rows.select(
            "row_number", "is_prepared", F.round(cell("value").try_cast("double"), 4).alias("value"), cell("reference_year").alias("reference_year"),
            cell("reference_period").alias("reference_period"), cell("kept").alias("kept"),
        )

    return run


query("r2_prepare_wide_column", _prepared_sql(WIDE_COLUMNS[2], "'1'"))(_prepared(WIDE_COLUMNS[2], False))
query("r3_reset_and_prepare_month", _prepared_sql(MONTH_COLUMNS[1], "CAST(NULL AS VARCHAR)", raw=True))(_prepared(MONTH_COLUMNS[1], True))


@query(
    "r2_prepared_counts",
    f"""WITH {WIDE_SQL} SELECT 'wide' AS import_id, count(*) FILTER (regexp_full_match(ibge, '[0-9]{{7}}') AND {WIDE_COLUMNS[2].field} IS NOT NULL) AS transformed_rows,
  count(*) FILTER (NOT regexp_full_match(ibge, '[0-9]{{7}}') OR {WIDE_COLUMNS[2].field} IS NULL) AS skipped_rows FROM wide""",
)
def prepared_counts(spark, folder):
    return reshape.prepared_counts(reshape.prepare_wide_column(_wide(spark, folder), WIDE_COLUMNS[2], "ibge"))


@query(
    "p5_period_columns",
    f"""WITH {WIDE_SQL} SELECT source_row AS row_number, {" || ',' || ".join(f"'{c.year}-{c.month or 0}:' || coalesce(printf('%.2f', {c.field}), '')" for c in WIDE_COLUMNS + MONTH_COLUMNS)} AS periods FROM wide""",
)
def title_columns(spark, folder):
    """Years and months come from the titles of the columns."""
    columns = reshape.period_columns(spark, [c.field for c in WIDE_COLUMNS + MONTH_COLUMNS])
    number = lambda c: F.coalesce(F.format_string("%.2f", parse_number(F.element_at("raw_row", c.field)).cast("double")), F.lit(""))
    found = [F.when(F.element_at("raw_row", c.field).isNull(), F.lit("")).otherwise(number(c)) for c in columns]
    texts = [F.concat(F.lit(f"{c.year}-{c.month or 0}:"), text) for c, text in zip(columns, found)]
    return _wide(spark, folder).select("row_number", F.concat_ws(",", *texts).alias("periods"))


@query(
    "f7_s7_derived_sheet",
    f"""WITH {WIDE_SQL} SELECT 'Dados · filtrada' AS sheet_name, row_number() OVER (ORDER BY source_row) AS row_number, CAST(source_row AS VARCHAR) AS origin_row_number,
  'Dados' AS origin_sheet FROM wide WHERE ibge <> '?'""",
)
def derived_sheet(spark, folder):
    from civigrade.operators.filters import RowFilter, filter_staged

    kept = filter_staged(_wide(spark, folder), [RowFilter("ibge", "neq", "?")])
    derived = tables.derive_sheet(kept, " · filtrada")
    cell = lambda name: F.try_element_at("normalized_row", F.lit(name))
    return derived.select("sheet_name", "row_number", cell("origin_row_number").alias("origin_row_number"), cell("origin_sheet").alias("origin_sheet"))


@query(
    "s7_replace_sheets",
    f"""WITH {WIDE_SQL}, old AS (SELECT unnest(['Dados', 'Dados · filtrada', 'Outra']) AS sheet_name, source_row FROM wide)
SELECT sheet_name, count(*) AS rows FROM (SELECT sheet_name FROM old WHERE sheet_name <> 'Dados · filtrada' UNION ALL SELECT 'Dados · filtrada' FROM wide WHERE ibge = '?') GROUP BY 1""",
)
def replace_sheets(spark, folder):
    sheets = F.array(*[F.lit(s) for s in ("Dados", "Dados · filtrada", "Outra")])
    old = _wide(spark, folder).withColumn("sheet_name", F.explode(sheets))
    derived = tables.derive_sheet(_wide(spark, folder).filter(F.element_at("raw_row", "ibge") == "?"), " · filtrada")
    return tables.replace_sheets(old, derived).groupBy("sheet_name").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s8_include_remaining",
    """WITH incoming AS (SELECT l_linestatus || l_returnflag AS sheet, count(*) AS n FROM lineitem GROUP BY 1)
SELECT sheet AS sheet_name, CASE WHEN sheet = 'FA' THEN (SELECT count(*) FROM orders) ELSE n END AS rows FROM incoming""",
)
def include_remaining(spark, folder):
    empty = F.lit(None).cast("map<string,string>")
    staged = model.table(spark, folder, "orders").select(
        F.lit("x").alias("import_id"), F.lit("FA").alias("sheet_name"), F.col("o_orderkey").alias("row_number"), empty.alias("raw_row")
    )
    incoming = model.table(spark, folder, "lineitem").select(
        F.lit("x").alias("import_id"), F.concat("l_linestatus", "l_returnflag").alias("sheet_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"), empty.alias("raw_row")
    )
    sheets = staged.groupBy("import_id", "sheet_name").agg(F.count(F.lit(1)).alias("row_count"))
    return tables.include_remaining(staged, sheets, incoming).groupBy("sheet_name").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a18_population_years",
    f"""WITH {PREPARED_SQL}, {model.POPULATION_SQL}, {YEARLY_SQL}, known AS (SELECT year, count(*) AS municipalities FROM yearly GROUP BY 1 HAVING count(*) >= 1000)
SELECT CAST(d.year AS INTEGER) AS year, municipalities, municipalities IS NULL AS is_missing FROM (SELECT DISTINCT year(day) AS year FROM prepared) d LEFT JOIN known USING (year)""",
)
def population_years(spark, folder):
    rows = _single(spark, folder).select(F.col("period.year").alias("year"))
    return benchmarks.population_years(rows, _population(spark, folder))
