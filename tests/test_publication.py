import json

import pytest
from pyspark.sql import functions as F

from civigrade.functions.periods import PeriodSelection
from civigrade.operators import lifecycle, preparation, publication, reshape
from civigrade.operators.preparation import IndicatorMapping
from civigrade.operators.reshape import PeriodColumn
from civigrade.sources import tables

YEAR = PeriodSelection("year_column", year_field="ano")
CATALOG = [("3509502", "Campinas", "SP"), ("3550308", "São Paulo", "SP"), ("1100015", "Alta Floresta", "RO")]
NOW = "2024-01-01"


def now():
    return F.lit(NOW).cast("timestamp")


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "ibge_code string, name string, state string")


def cell(name, column="normalized_row"):
    return F.try_element_at(column, F.lit(name))


def test_single_preparation_reports_each_failure(stage_rows, catalog):
    rows = stage_rows([
        {"municipio": "3509502", "ano": "2023", "valor": "1.234,5"}, {"municipio": "110001", "ano": "x", "valor": "abc"}, {"municipio": "9", "ano": "2023", "valor": ""},
    ])
    prepared = preparation.prepare_single(rows, YEAR, "valor", "municipio", catalog)
    got = {r["row_number"]: r for r in prepared.collect()}
    assert (got[1]["municipality_code"], got[1]["period"]["year"], float(got[1]["value"])) == ("3509502", 2023, 1234.5)
    assert got[2]["municipality_code"] == "1100015"
    problems = {(r["row_number"], r["kind"], r["text"]) for r in preparation.problem_rows(prepared).collect()}
    assert problems == {(2, "period", "x"), (2, "value", "abc"), (3, "municipality", "9")}


EMPLOYMENT = [
    IndicatorMapping("empregos", "pessoas", value_field="estoque"),
    IndicatorMapping("taxa", "%", "ratio", numerator_field="admissoes", denominator_field="estoque", multiplier=100),
]


def test_batch_prepares_several_measures_and_keeps_earlier_ones(stage_rows, catalog):
    earlier = {"indicator_values": '{"anterior":"7"}', "note": "kept", "reference_year": "1999"}
    rows = stage_rows([{"municipio": "3509502", "ano": "2023", "estoque": "1.234", "admissoes": "123,4"}], [earlier])
    got = {r["indicator_code"]: r for r in preparation.prepare_batch(rows, YEAR, EMPLOYMENT, "municipio", catalog).collect()}
    assert (float(got["empregos"]["value"]), float(got["taxa"]["value"])) == (1234.0, 10.0)
    assert json.loads(got["taxa"]["calculation"])["type"] == "ratio"
    stored = preparation.with_prepared_cells(rows, YEAR, EMPLOYMENT, "municipio", catalog).first()["normalized_row"]
    assert json.loads(stored["indicator_values"]) == {"anterior": "7", "empregos": "1234", "taxa": "10"}
    assert (stored["note"], stored["reference_year"], stored[preparation.APPROVAL_CODE_FIELD]) == ("kept", "2023", "3509502")
    assert stored["value__taxa"] == "10" and "reference_period" not in stored


def test_batch_reports_bad_values_per_indicator(stage_rows, catalog):
    mappings = [EMPLOYMENT[0], IndicatorMapping("taxa", "%", "ratio", numerator_field="admissoes", denominator_field="zero")]
    rows = stage_rows([{"municipio": "3509502", "ano": "2023", "estoque": "texto", "admissoes": "12", "zero": "0"}] * 7)
    prepared = preparation.prepare_batch(rows, YEAR, mappings, "municipio", catalog)
    assert {r["indicator_code"]: r["value_problem_count"] for r in preparation.batch_problems(prepared).collect()} == {"empregos": 7, "taxa": 7}
    samples = preparation.batch_problem_samples(prepared).collect()
    assert len(samples) == 10 and {r["source_measure"] for r in samples} == {"texto", "12 / 0"}


def test_ratio_to_the_population_of_the_row_year(spark, stage_rows, catalog):
    mapping = [IndicatorMapping("leitos", "por mil", "ratio_population", numerator_field="leitos", multiplier=1000)]
    population = spark.createDataFrame([(2024, "3509502", 1_000_000), (2024, "3550308", 0)], "year int, ibge_code string, inhabitants long")
    rows = stage_rows([
        {"municipio": "3509502", "ano": "2024", "leitos": "2.500"}, {"municipio": "1100015", "ano": "2024", "leitos": "10"},
        {"municipio": "3509502", "ano": "1999", "leitos": "10"}, {"municipio": "3550308", "ano": "2024", "leitos": "10"},
    ])
    prepared = preparation.prepare_batch(rows, YEAR, mapping, "municipio", catalog, population)
    got = [None if r["value"] is None else float(r["value"]) for r in prepared.orderBy("row_number").collect()]
    assert got == [2.5, None, None, None]


def test_limits_clamp_direct_values(stage_rows, catalog):
    rows = stage_rows([{"municipio": "3509502", "ano": "2026", "c": "408,87"}])
    prepared = preparation.prepare_batch(rows, YEAR, [IndicatorMapping("aps", "%", value_field="c", value_max=100.0)], "municipio", catalog)
    assert float(prepared.first()["value"]) == 100.0


def test_bad_mappings_are_refused():
    for bad in ({"value_field": None}, {"calculation": "ratio", "numerator_field": "a", "denominator_field": "a"}, {"value_field": "a", "multiplier": 0}, {"value_field": "a", "unit": " "}):
        with pytest.raises(ValueError):
            IndicatorMapping(**{"indicator_code": "i", "unit": "u", **bad})
    with pytest.raises(ValueError):
        preparation.check_mappings([EMPLOYMENT[0]] * 2)
    with pytest.raises(ValueError):
        preparation.check_mappings([])


def test_preview(stage_rows):
    rows = stage_rows([{"municipio": "C", "a": "1,234", "b": "2"}, {"municipio": "D", "a": "x", "b": "2"}, {"municipio": "E", "a": "1", "b": "0"}])
    preview = preparation.preview_rows(rows, "ratio", "", "a", "b", 10.0)
    assert tuple(preparation.preview_counts(preview).first())[1:] == (3, 1, 2)
    first = preparation.preview_examples(preview).first()
    assert (first["calculated_value"], first["municipality"], first["numerator"]) == (6170.0, "C", "1,234")
    with pytest.raises(ValueError):
        preparation.preview_rows(rows, "ratio", "", "a", "a", 1.0)


def candidates(spark, rows):
    """(sheet, row, code, period, value) -> candidate rows; a code of '' is an unknown municipality."""
    df = spark.createDataFrame(rows, "sheet_name string, row_number long, municipality_code string, p string, v string")
    prepared = df.select(
        F.lit("imp").alias("import_id"), F.lit("ind").alias("indicator_code"), "sheet_name", "row_number",
        F.when(F.col("municipality_code") != "", F.col("municipality_code")).alias("municipality_code"),
        F.when(F.col("p") != "", F.struct(F.left("p", F.lit(4)).cast("int").alias("year"), F.substring("p", 6, 2).try_cast("int").alias("month"))).alias("period"),
        F.col("v").try_cast("decimal(38,10)").alias("value"), F.lit("u").alias("unit"),
    )
    return publication.prepared_candidates(prepared)


def approve(spark, rows, observations=None, issues=None, **options):
    observations = observations if observations is not None else publication.empty(spark, publication.OBSERVATION)
    issues = issues if issues is not None else publication.empty(spark, publication.ISSUE)
    return publication.approve(candidates(spark, rows), observations, issues, now(), **options)


def active(df):
    rows = df.filter(F.col("superseded_at").isNull()).collect()
    return sorted((r["municipality_code"], str(r["reference_period"]), float(r["value"]), r["source_sheet"]) for r in rows)


ROWS = [
    ("A", 1, "3509502", "2023", "10"), ("A", 2, "3550308", "2023-05", "11"), ("A", 3, "3550308", "2023-05", "12"), ("A", 4, "", "2023", "1"),
    ("A", 5, "1100015", "", "1"), ("A", 6, "1100015", "2023", "x"), ("A", 7, "1100015", "2024-01", "5"), ("A", 8, "1100015", "2024", "6"),
]


def test_only_valid_unique_rows_are_published(spark):
    result = approve(spark, ROWS)
    # Row 7 (January 2024) and row 8 (year 2024) fall on the same date: both count as duplicates.
    assert active(result.observations) == [("3509502", "2023-01-01", 10.0, "A")]
    issues = {(r["row_number"], r["field"]) for r in result.issues.collect()}
    code = "approval_municipality_ibge_code"
    assert issues == {(2, code), (3, code), (4, code), (5, "reference_year"), (6, "value"), (7, code), (8, code)}


def test_issues_and_observations_cover_all_candidates(spark):
    result = approve(spark, ROWS)
    with_issue = result.issues.select("row_number").distinct()
    assert with_issue.count() + result.observations.count() == len(ROWS)


def test_approving_again_gives_the_same_active_rows(spark):
    first = approve(spark, ROWS)
    second = approve(spark, ROWS, first.observations, first.issues)
    assert active(second.observations) == active(first.observations)
    assert second.observations.filter(F.col("superseded_at").isNotNull()).count() == 1
    assert sorted(map(tuple, second.issues.collect())) == sorted(map(tuple, first.issues.collect()))


def test_another_sheet_conflicts_and_its_issues_stay(spark):
    first = approve(spark, [("A", 1, "3509502", "2023", "10"), ("A", 2, "", "2023", "1")])
    second = approve(spark, [("B", 1, "3509502", "2023", "99"), ("B", 2, "3550308", "2023", "7")], first.observations, first.issues)
    assert active(second.observations) == [("3509502", "2023-01-01", 10.0, "A"), ("3550308", "2023-01-01", 7.0, "B")]
    messages = sorted(r["message"][:7] for r in second.issues.collect())
    assert messages == ['Aba "A"', 'Aba "B"']


def test_sheets_can_be_judged_one_by_one(spark):
    rows = [("A", 1, "3509502", "2023", "10"), ("B", 1, "3509502", "2023", "11")]
    assert approve(spark, rows).observations.count() == 0
    assert approve(spark, rows, by_sheet=True).observations.count() == 2


def test_published_values_follow_the_observations(spark):
    imports = spark.createDataFrame([("imp", "d")], "import_id string, dataset_id string")
    indicators = spark.createDataFrame([("ind", "Name")], "indicator_code string, indicator_name string")
    none = publication.empty(spark, publication.PUBLISHED)
    first = approve(spark, [("A", 1, "3509502", "2023", "10"), ("A", 2, "3550308", "2023", "1")])
    one = publication.sync_published(none, first.observations, imports, indicators, now())
    second = approve(spark, [("A", 1, "3509502", "2023", "20"), ("A", 2, "1100015", "2023", "3")], first.observations)
    two = publication.sync_published(one, second.observations, imports, indicators, now())
    state = sorted((r["municipality_ibge_code"], float(r["value"]), r["superseded_at"] is None, r["indicator_name"]) for r in two.collect())
    assert state == [("1100015", 3.0, True, "Name"), ("3509502", 20.0, True, "Name"), ("3550308", 1.0, False, "Name")]
    ids = {r["municipality_ibge_code"]: r["id"] for r in one.collect()}
    assert {r["municipality_ibge_code"]: r["id"] for r in two.collect()}["3509502"] == ids["3509502"]


def test_text_candidates_need_plain_numbers_and_full_codes(stage_rows, catalog):
    rows = stage_rows([
        {"m": "3509502", "y": "2023.0", "v": "10.5"}, {"m": "350950", "y": "2023", "v": "1"}, {"m": "3509502", "y": "23", "v": "1"}, {"m": "3509502", "y": "2023", "v": "1,5"},
        {"m": "3509502", "y": "2023", "v": "1", "reference_period": "2023-07-01"},
    ])
    fields = publication.FieldNames("m", "y", "v")
    got = publication.text_candidates(rows, catalog, fields, "i", "u").orderBy("row_number").collect()
    assert [(r["valid_municipality"], r["valid_year"], r["valid_value"]) for r in got] == [(True, True, True), (False, True, True), (True, False, True), (True, True, False), (True, True, True)]
    assert [str(r["reference_period"]) for r in got] == ["2023-01-01", "2023-01-01", "None", "2023-01-01", "2023-07-01"]


def test_expand_periods(spark, stage_rows, catalog):
    columns = [PeriodColumn("janeiro_2020_saldos", 2020, 1), PeriodColumn("valor_2021", 2021)]
    rows = stage_rows([
        {"codigo_ibge": "110001", "uf": "RO", "janeiro_2020_saldos": "1.234,5", "valor_2021": ""}, {"codigo_ibge": "x", "uf": "RO", "janeiro_2020_saldos": "abc", "valor_2021": "10%"},
    ])
    identity = reshape.identity_fields(["codigo_ibge", "uf", "valor_2021"], "codigo_ibge")
    out = reshape.expand_periods(rows, columns, "codigo_ibge", catalog, identity, " saldos ")
    got = out.orderBy("row_number").collect()
    assert got[0]["sheet_name"] == "Dados · saldos por período"
    assert [(r["row_number"], r["raw_row"]["competencia"], r["normalized_row"].get("value")) for r in got] == [(1, "2020-01-01", "1234.5"), (2, "2020-01-01", None), (3, "2021", "10")]
    assert got[0]["normalized_row"]["municipality_ibge_code"] == "1100015" and got[0]["raw_row"]["uf"] == "RO"
    assert "valor_2021" not in got[0]["raw_row"] and got[2]["raw_row"]["valor"] == "10%"
    assert tuple(reshape.expansion_counts(rows, out, 2).first()) == ("imp", 3, 1, 2)


def test_wide_column_clears_rows_it_cannot_read(stage_rows):
    rows = stage_rows([{"c": "3509502", "julho_2024_saldo": "1.500"}, {"c": "350950", "julho_2024_saldo": "2"}], [{"value": "9", "k": "1"}] * 2)
    prepared = reshape.prepare_wide_column(rows, PeriodColumn("julho_2024_saldo", 2024, 7), "c")
    got = prepared.orderBy("row_number").collect()
    assert got[0]["normalized_row"] == {"k": "1", "municipality_ibge_code": "3509502", "reference_year": "2024", "reference_period": "2024-07-01", "value": "1500", "source_measure": "julho_2024_saldo"}
    assert got[1]["normalized_row"] == {"k": "1"}
    assert tuple(reshape.prepared_counts(prepared).first()) == ("imp", 1, 1)


def test_derived_sheets_replace_earlier_ones(stage_rows):
    rows = stage_rows([{"a": str(i)} for i in range(1, 6)])
    derived = tables.derive_sheet(rows.filter(F.col("row_number") % 2 == 1), " · filtrada")
    both = tables.replace_sheets(tables.replace_sheets(rows, derived), derived)
    assert both.groupBy("sheet_name").count().orderBy("sheet_name").collect()[1]["count"] == 3
    got = [(r["row_number"], r["normalized_row"]["origin_row_number"]) for r in derived.orderBy("row_number").collect()]
    assert got == [(1, "1"), (2, "3"), (3, "5")]


def test_life_cycle(spark):
    imports = spark.createDataFrame(
        [("a", "approved", 1), ("b", "discarded", 1), ("c", "needs_review", 2), ("d", "archived", 3)], "import_id string, status string, source_id int"
    ).withColumns({"approved_at": F.lit(None).cast("timestamp"), "archived_at": F.lit(None).cast("timestamp"), "created_at": now(), "title": F.col("import_id")})
    facts = spark.createDataFrame([("a", None), ("a", NOW), ("c", None)], "import_id string, s string").withColumn("superseded_at", F.col("s").cast("timestamp"))
    assert lifecycle.withdrawn_counts(facts, imports, ["a", "c"]).collect() == [("a", 1)]
    assert lifecycle.supersede_import(facts, imports, ["a", "c"], now()).filter("superseded_at is null").collect()[0]["import_id"] == "c"
    status = lambda df: {r["import_id"]: r["status"] for r in df.collect()}
    assert status(lifecycle.unapprove(imports, ["a", "c"])) == {"a": "needs_review", "b": "discarded", "c": "needs_review", "d": "archived"}
    assert status(lifecycle.archive(imports, ["a", "b"], now()))["b"] == "discarded"
    assert [r["import_id"] for r in lifecycle.list_imports(imports, "archived").collect()] == ["d"]
    assert "b" not in status(lifecycle.list_imports(imports))
    assert lifecycle.check_delete(imports, ["a"]).count() == 1 and lifecycle.check_delete(imports, ["a"], force=True).count() == 0
    sources = spark.createDataFrame([(1,), (2,), (3,)], "source_id int")
    _, kept, left, counts = lifecycle.delete_cascade({"facts": facts}, imports, sources, ["a", "c"])
    assert sorted(status(kept)) == ["b", "d"] and sorted(r[0] for r in left.collect()) == [1, 3]
    assert {r["table"]: r["rows"] for r in counts.collect()} == {"facts": 3, "imports": 2, "sources": 1}
