"""Validation of candidates, issues, observations and published values.

Facts are versioned: a replaced row gets ``superseded_at``, nothing is deleted. All functions take
and return whole tables, any number of imports, sheets and indicators at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.periods import FIRST_YEAR, LAST_YEAR, MONTH_START, month_start_text
from civigrade.functions.text import cell_text, merged_field
from civigrade.functions.values import SIMPLE, STORED
from civigrade.operators.joins import attach_counted, lookup
from civigrade.session import materialise

# The messages of the five validation rules.
MESSAGES = {
    "municipality": "Código IBGE inválido ou município inexistente.",
    "year": "Ano inválido. Informe um ano entre 1900 e 2200.",
    "value": "Valor inválido. Informe um número com ponto decimal ou converta o formato brasileiro antes da gravação.",
    "duplicate": "Mais de uma linha deste arquivo informa valor para o mesmo município e período; nenhuma delas foi gravada.",
    "conflict": "Outra aba deste arquivo já informa um valor para o mesmo município e período; escolha uma única linha de origem.",
}
OBSERVATION = (
    "import_id string, indicator_code string, municipality_code string, reference_year int, reference_period date, "
    "value decimal(38,10), unit string, source_sheet string, source_row_number long, is_monthly boolean, superseded_at timestamp"
)
PUBLISHED = (
    "id string, import_id string, dataset_id string, indicator_code string, indicator_name string, "
    "municipality_ibge_code string, reference_period date, value decimal(38,10), unit string, source_sheet string, "
    "source_row_number long, is_monthly boolean, superseded_at timestamp"
)
ISSUE = "import_id string, indicator_code string, severity string, row_number long, field string, message string"
SCOPE = ["import_id", "indicator_code", "sheet_name"]
OBSERVATION_KEY = ["import_id", "indicator_code", "municipality_code", "reference_period"]


@dataclass(frozen=True)
class FieldNames:
    """Names of the fields issues refer to."""

    municipality: str = "approval_municipality_ibge_code"
    year: str = "reference_year"
    value: str = "value"


def text_candidates(
    staged: DataFrame, municipalities: DataFrame, fields: FieldNames, indicator_code: str, unit: str, longest_value: int | None = None
) -> DataFrame:
    """Candidates from the prepared text cells of staged rows, checked against the catalog.

    With ``longest_value`` longer texts are no numbers.
    """
    cell = lambda name: merged_field(F.col("raw_row"), F.col("normalized_row"), name)
    year_text = cell_text(cell(fields.year))
    value_text = cell_text(cell(fields.value))
    period_text = cell("reference_period")
    year = F.regexp_extract(year_text, r"^([0-9]{4})([.]0+)?$", 1).try_cast("int")
    short_enough = F.lit(True) if longest_value is None else F.length(value_text) <= longest_value
    checked = staged.select(
        "import_id", F.lit(indicator_code).alias("indicator_code"), "sheet_name", "row_number",
        cell_text(cell(fields.municipality)).alias("municipality_code"),
        F.when(year.between(FIRST_YEAR, LAST_YEAR), year).alias("reference_year"),
        F.when(short_enough & value_text.rlike(f"^{SIMPLE}$"), value_text.try_cast(STORED)).alias("value"),
        F.when(period_text.rlike(MONTH_START), period_text.try_cast("date")).alias("month_period"),
        F.lit(unit).alias("unit"),
    )
    return _validated(checked, municipalities)


def prepared_candidates(prepared: DataFrame, municipalities: DataFrame | None = None) -> DataFrame:
    """Candidates from typed rows of ``prepare_batch``; their codes already come from the catalog."""
    checked = prepared.select(
        "import_id", "indicator_code", "sheet_name", "row_number", F.coalesce("municipality_code", F.lit("")).alias("municipality_code"),
        F.col("period")["year"].alias("reference_year"), "value",
        month_start_text(F.col("period")).try_cast("date").alias("month_period"), "unit",
    )
    return _validated(checked, municipalities)


def _validated(checked: DataFrame, municipalities: DataFrame | None) -> DataFrame:
    """Flags per rule; the period is the stated month, else January of the year."""
    if municipalities is None:
        known = checked.withColumn("valid_municipality", F.col("municipality_code").rlike("^[0-9]{7}$"))
    else:
        catalog = lookup(
            municipalities.select(F.col("ibge_code").alias("municipality_code")).distinct().withColumn("in_catalog", F.lit(True))
        )
        known = checked.join(catalog, "municipality_code", "left").withColumn(
            "valid_municipality", F.col("municipality_code").rlike("^[0-9]{7}$") & F.coalesce("in_catalog", F.lit(False))
        )
    january = F.make_date(F.col("reference_year"), F.lit(1), F.lit(1))
    return (
        known.withColumn("valid_year", F.col("reference_year").isNotNull())
        .withColumn("valid_value", F.col("value").isNotNull())
        .withColumn("is_valid", F.col("valid_municipality") & F.col("valid_year") & F.col("valid_value"))
        .withColumn("is_monthly", F.col("month_period").isNotNull())
        .withColumn("reference_period", F.coalesce("month_period", january))
        .select(
            *SCOPE, "row_number", "municipality_code", "reference_year", "reference_period", "value", "unit", "is_monthly",
            "valid_municipality", "valid_year", "valid_value", "is_valid",
        )
    )


def mark_duplicates(candidates: DataFrame, by_sheet: bool = False) -> DataFrame:
    """Add ``duplicate_count``: valid candidates of the same municipality and period, 0 for invalid ones.

    Counted within an import and indicator, or within each sheet when sheets are approved one by one.
    """
    return _judge(candidates, _duplicate_counts(candidates, by_sheet), by_sheet)


def mark(candidates: DataFrame, observations: DataFrame, by_sheet: bool = False) -> DataFrame:
    """Add ``duplicate_count`` and ``is_conflict``.

    A conflict is an active observation another sheet of the import already has for the same key. It is
    looked up once per key, so a key with many candidates costs no more than one with a single one.
    """
    active = observations.filter(F.col("superseded_at").isNull()).select(
        *OBSERVATION_KEY, F.coalesce("source_sheet", F.lit("")).alias("_taken_by")
    )
    counts = _duplicate_counts(candidates, by_sheet).join(active, OBSERVATION_KEY, "left")
    judged = _judge(candidates, counts, by_sheet)
    other = F.col("_taken_by").isNotNull() & (F.col("_taken_by") != F.coalesce("sheet_name", F.lit("")))
    return judged.withColumn("is_conflict", F.col("is_valid") & other).drop("_taken_by")


def _duplicate_key(by_sheet: bool) -> list[str]:
    return OBSERVATION_KEY + (["sheet_name"] if by_sheet else [])


def _duplicate_counts(candidates: DataFrame, by_sheet: bool) -> DataFrame:
    valid = candidates.filter("is_valid")
    return valid.groupBy(*_duplicate_key(by_sheet)).agg(F.count(F.lit(1)).alias("duplicate_count"))


def _judge(candidates: DataFrame, counts: DataFrame, by_sheet: bool) -> DataFrame:
    judged = attach_counted(candidates.filter("is_valid"), counts, _duplicate_key(by_sheet))
    invalid = candidates.filter(~F.col("is_valid")).withColumn("duplicate_count", F.lit(0).cast("long"))
    return judged.unionByName(invalid, allowMissingColumns=True)


def message_prefix(sheet: Column) -> Column:
    """How the messages of a sheet begin; a row without a sheet belongs to the nameless one."""
    return F.concat(F.lit('Aba "'), F.coalesce(sheet, F.lit("")), F.lit('": '))


def issues_of(candidates: DataFrame, fields: FieldNames) -> DataFrame:
    """One row per broken rule of a marked candidate."""
    rules = (
        (fields.municipality, ~F.col("valid_municipality"), "municipality"),
        (fields.year, ~F.col("valid_year"), "year"),
        (fields.value, ~F.col("valid_value"), "value"),
        (fields.municipality, F.col("duplicate_count") > 1, "duplicate"),
        (fields.municipality, F.col("is_conflict"), "conflict"),
    )
    broken = F.array_compact(
        F.array(
            *[
                F.when(has_error, F.struct(F.lit(field).alias("field"), F.lit(MESSAGES[rule]).alias("text")))
                for field, has_error, rule in rules
            ]
        )
    )
    return candidates.select("import_id", "indicator_code", "sheet_name", "row_number", F.explode(broken).alias("b")).select(
        "import_id", "indicator_code", F.lit("error").alias("severity"), F.col("row_number").cast("long").alias("row_number"),
        F.col("b.field").alias("field"), F.concat(message_prefix(F.col("sheet_name")), "b.text").alias("message"),
    )


def refresh_issues(existing: DataFrame, new: DataFrame, scope: DataFrame, fields: FieldNames) -> DataFrame:
    """Issue table after an approval: earlier ones of the same import, indicator, sheet and fields make way."""
    ours = [fields.municipality, fields.year, fields.value]
    approved = scope.select(F.col("import_id").alias("_import"), F.col("indicator_code").alias("_indicator"), message_prefix(F.col("sheet_name")).alias("_prefix"))
    same = (F.col("import_id") == F.col("_import")) & (F.col("indicator_code") == F.col("_indicator"))
    stale = same & F.col("field").isin(*ours) & F.startswith("message", F.col("_prefix"))
    kept = existing.join(approved, stale, "left_anti")
    key = ["import_id", "indicator_code", "row_number", "field", "message"]
    added = new.join(kept.select(*key), key, "left_anti")
    return kept.unionByName(added.select(*kept.columns))


def supersede_scope(observations: DataFrame, scope: DataFrame, now: Column) -> DataFrame:
    """Mark the active observations an approval replaces: same import and indicator, same or no sheet."""
    replaced = scope.select(*SCOPE).withColumn("_replaced", F.lit(True))
    pairs = scope.select("import_id", "indicator_code").distinct().withColumn("_any", F.lit(True))
    marked = (
        observations.withColumn("sheet_name", F.coalesce("source_sheet", F.lit("")))
        .join(replaced, SCOPE, "left")
        .join(pairs, ["import_id", "indicator_code"], "left")
    )
    gone = F.col("superseded_at").isNull() & (
        F.col("_replaced").isNotNull() | (F.col("_any").isNotNull() & (F.col("sheet_name") == ""))
    )
    return marked.withColumn("superseded_at", F.when(gone, now).otherwise(F.col("superseded_at"))).select(*observations.columns)


def accepted(candidates: DataFrame) -> DataFrame:
    """Observations of the marked candidates that are valid, unique and without conflict."""
    return candidates.filter(F.col("is_valid") & (F.col("duplicate_count") == 1) & ~F.col("is_conflict")).select(
        "import_id", "indicator_code", "municipality_code", "reference_year", "reference_period", "value", "unit",
        F.col("sheet_name").alias("source_sheet"), F.col("row_number").cast("long").alias("source_row_number"), "is_monthly",
        F.lit(None).cast("timestamp").alias("superseded_at"),
    )


@dataclass(frozen=True)
class Approval:
    """Tables after an approval, and the candidates it judged."""

    candidates: DataFrame
    observations: DataFrame
    issues: DataFrame


def approve(
    candidates: DataFrame, observations: DataFrame, issues: DataFrame, now: Column, fields: FieldNames = FieldNames(),
    by_sheet: bool = False, scope: DataFrame | None = None,
) -> Approval:
    """Approve all candidates at once. Running it again on the same rows gives the same active observations.

    ``scope`` names the imports, indicators and sheets approved (a small table); without it they are
    taken from the candidates.
    """
    # Candidates are read for counting and marking, marked ones for issues and observations: each is written once.
    candidates = materialise(candidates, "candidates")
    scope = candidates.select(*SCOPE).distinct() if scope is None else lookup(scope.select(*SCOPE).distinct())
    remaining = supersede_scope(observations, scope, now)
    marked = materialise(mark(candidates, remaining, by_sheet), "marked")
    new_issues = issues_of(marked, fields)
    return Approval(
        marked,
        remaining.unionByName(accepted(marked).select(*remaining.columns)),
        refresh_issues(issues, new_issues, scope, fields),
    )


def sync_published(
    published: DataFrame, observations: DataFrame, imports: DataFrame, indicators: DataFrame, now: Column
) -> DataFrame:
    """Published values after the observations changed.

    Active values without an active observation are superseded, those with one take its value, and
    new observations of known imports and indicators are added with a name and a stable id.
    """
    key = ["import_id", "indicator_code", "municipality_ibge_code", "reference_period"]
    source = ["value", "unit", "source_sheet", "source_row_number", "is_monthly"]
    current = observations.filter(F.col("superseded_at").isNull()).select(
        "import_id", "indicator_code", F.col("municipality_code").alias("municipality_ibge_code"), "reference_period",
        F.struct(*source).alias("_new"),
    )
    active = published.filter(F.col("superseded_at").isNull())
    history = published.filter(F.col("superseded_at").isNotNull())
    joined = active.join(current, key, "full")
    names = lookup(indicators.select("indicator_code", F.col("indicator_name").alias("_name")))
    datasets = lookup(imports.select("import_id", F.col("dataset_id").alias("_dataset"), F.lit(True).alias("_known")))
    named = joined.join(names, "indicator_code", "left").join(datasets, "import_id", "left")
    is_new = F.col("id").isNull()
    id_text = F.md5(F.concat_ws("|", *key, now.cast("string")))
    rows = named.filter(~is_new | (F.col("_name").isNotNull() & F.col("_known").isNotNull())).select(
        F.coalesce("id", id_text).alias("id"),
        "import_id",
        F.when(is_new, F.col("_dataset")).otherwise(F.col("dataset_id")).alias("dataset_id"),
        "indicator_code",
        F.when(is_new, F.col("_name")).otherwise(F.col("indicator_name")).alias("indicator_name"),
        "municipality_ibge_code",
        "reference_period",
        *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in source],
        F.when(F.col("_new").isNull(), now).alias("superseded_at"),
    )
    return history.unionByName(rows.select(*history.columns))


def approved_counts(observations: DataFrame) -> DataFrame:
    """Active observations per import and indicator."""
    return (
        observations.filter(F.col("superseded_at").isNull())
        .groupBy("import_id", "indicator_code")
        .agg(F.count(F.lit(1)).alias("approved_rows"))
    )


def set_status(imports: DataFrame, judged: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """Imports after an approval: approved when any row was published, else for review. ``judged`` has their ids."""
    totals = approved_counts(observations).groupBy("import_id").agg(F.sum("approved_rows").alias("_approved"))
    touched = judged.select("import_id").distinct().join(totals, "import_id", "left").withColumn("_judged", F.lit(True))
    joined = imports.join(touched, "import_id", "left")
    any_row = F.coalesce("_approved", F.lit(0)) > 0
    is_judged = F.col("_judged").isNotNull()
    status = F.when(is_judged, F.when(any_row, "approved").otherwise("needs_review")).otherwise(F.col("status"))
    approved_at = F.when(is_judged, F.when(any_row, now)).otherwise(F.col("approved_at"))
    return joined.withColumn("status", status).withColumn("approved_at", approved_at).select(*imports.columns)


def approve_generic(imports: DataFrame, proposals: DataFrame, import_id: str, mapping: str, explanation: str, now: Column):
    """Store a treatment proposal and mark the import approved; nothing is published. Returns both tables."""
    proposal = imports.filter(F.col("import_id") == import_id).select(
        "import_id", F.lit(mapping).alias("mapping"), F.lit(explanation).alias("explanation"), F.lit(1.0).alias("confidence")
    )
    is_it = F.col("import_id") == import_id
    marked = imports.withColumn("status", F.when(is_it, F.lit("approved")).otherwise(F.col("status"))).withColumn(
        "approved_at", F.when(is_it, now).otherwise(F.col("approved_at"))
    )
    return marked, proposals.unionByName(proposal)


def serving_view(published: DataFrame, imports: DataFrame, sources: DataFrame, datasets: DataFrame, domains: DataFrame) -> DataFrame:
    """Active values of approved, unarchived imports that have a source, with dataset, domain and granularity."""
    live = imports.filter((F.col("status") == "approved") & F.col("archived_at").isNull())
    envelope = live.join(lookup(sources.select("source_id", "source_name")), "source_id").select(
        "import_id", F.col("title").alias("import_title"), "source_name"
    )
    classes = datasets.join(domains.select("domain_id", "domain_name"), "domain_id", "left").select(
        "dataset_id", "dataset_name", "domain_name"
    )
    return (
        published.filter(F.col("superseded_at").isNull())
        .join(lookup(envelope), "import_id")
        .join(lookup(classes), "dataset_id", "left")
        .withColumn("period_granularity", F.when(F.col("is_monthly"), F.lit("month")).otherwise(F.lit("year")))
        .select(
            "id", "import_id", "dataset_id", "dataset_name", "domain_name", "indicator_code", "indicator_name",
            "municipality_ibge_code", "reference_period", "value", "unit", "import_title", "source_name", "period_granularity",
        )
    )


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
