import pytest
from pyspark.sql import functions as F

from civigrade.functions.values import filter_key, short_number
from civigrade.operators import filters, geography
from civigrade.operators.filters import RowFilter

CATALOG = [
    ("3509502", "Campinas", "SP"), ("3550308", "São Paulo", "SP"), ("4302105", "Bom Jesus", "RS"), ("4302303", "Bom Jesus", "RS"), ("1100015", "Alta Floresta D'Oeste", "RO"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "ibge_code string, name string, state string")


def _rows(spark, cells):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells, start=1)], "row_number int, cell string")


def test_codes(spark, catalog):
    rows = _rows(spark, ["110001", "1100015", "110001.0", "999999", "abc", None, "3509502.00"])
    got = geography.resolve_codes(rows, F.col("cell"), catalog).orderBy("row_number").collect()
    assert [r["municipality_code"] for r in got] == ["1100015", "1100015", "1100015", None, None, None, "3509502"]


def test_prefix_shared_by_two_codes_is_not_resolved(spark):
    catalog = spark.createDataFrame([("1234561", "A", "SP"), ("1234562", "B", "SP")], "ibge_code string, name string, state string")
    got = geography.resolve_codes(_rows(spark, ["123456"]), F.col("cell"), catalog).first()
    assert got["municipality_code"] is None


def test_name_matches(spark, catalog):
    names = ["Campinas (SP)", "São Paulo (SP)", "Bom Jesus (RS)", "Campinas", "Cidade Inexistente", "", "350950", "9999999"]
    matches = geography.match_names(_rows(spark, names), F.col("cell"), catalog)
    got = {r["row_number"]: r for r in matches.collect()}
    assert [got[i]["status"] for i in range(1, 9)] == ["matched", "matched", "ambiguous", "ambiguous", "unmatched", "unmatched", "matched", "unmatched"]
    assert got[1]["suggestion"]["ibge_code"] == "3509502" and got[7]["suggestion"]["ibge_code"] == "3509502"
    assert got[3]["candidate_count"] == 2
    pairs = {(r["original_name"], r["ibge_code"]) for r in geography.candidates_of(matches, catalog).collect()}
    assert pairs == {("Bom Jesus (RS)", "4302105"), ("Bom Jesus (RS)", "4302303"), ("Campinas", "3509502")}


def test_groups_decisions_and_checks(spark, catalog):
    names = ["Campinas", "Campinas", "Santos", "São Paulo (SP)", "Bom Jesus (RS)", ""]
    matches = geography.match_names(_rows(spark, names), F.col("cell"), catalog)
    groups = geography.group_matches(matches)
    order = [r["original_name"] for r in geography.ordered_groups(groups).collect()]
    assert order == ["Campinas", "Bom Jesus (RS)", "Santos", "São Paulo (SP)"]
    assert geography.blank_names(matches).first()["blank_rows"] == 1
    decisions = spark.createDataFrame(
        [("Campinas", "3509502", "candidate"), ("Santos", "3550308", "manual"), ("Bom Jesus (RS)", "3550308", "candidate")],
        "original_name string, ibge_code string, origin string",
    )
    decided = geography.decide(groups, decisions)
    confirmed = geography.confirmed_matches(matches, decided)
    assert sorted((r["row_number"], r["ibge_code"], r["origin"]) for r in confirmed.collect()) == [
        (1, "3509502", "candidate"), (2, "3509502", "candidate"), (3, "3550308", "manual"), (4, "3550308", "exact"), (5, "3550308", "candidate"),
    ]
    problems = geography.check_matches(confirmed, matches, catalog)
    assert [(r["row_number"], r["problem"]) for r in problems.collect()] == [(5, "does not match the name")]
    twice = confirmed.unionByName(confirmed.filter(F.col("row_number") == 4)).unionByName(
        spark.createDataFrame([(99, "0000000", "manual")], "row_number int, ibge_code string, origin string")
    )
    found = {(r["row_number"], r["problem"]) for r in geography.check_matches(twice, matches, catalog).collect()}
    assert {(4, "row sent twice"), (99, "unknown code"), (99, "unknown row")} <= found


def test_catalog_search(spark, catalog):
    search = lambda t: [r["name"] for r in geography.search_catalog(catalog, t).collect()]
    assert search("são") == ["São Paulo"] and search("35") == ["Campinas", "São Paulo"]
    assert search("Bom Jesus (RS)") == ["Bom Jesus", "Bom Jesus"] and search("a") == []
    assert [r["name"] for r in geography.search_registered(catalog, "camp").collect()] == ["Campinas"]


def test_register_and_regions(spark, catalog):
    incoming = spark.createDataFrame([("3509502", "Campinas Nova", "SP"), ("1", "X", "AC")], "ibge_code string, name string, state string")
    names = {r["ibge_code"]: r["name"] for r in geography.register(catalog, incoming).collect()}
    assert names["3509502"] == "Campinas Nova" and len(names) == 6
    document = '{"id":5101837,"nome":"Boa Esperança do Norte","microrregiao":null,"regiao-imediata":{"regiao-intermediaria":{"UF":{"sigla":"MT"}}}}'
    other = '{"id":11,"nome":"B","microrregiao":{"mesorregiao":{"UF":{"sigla":"RO"}}},"regiao-imediata":null}'
    path = _write_lines(spark, [document, other])
    got = [tuple(r) for r in geography.catalog_from_regions(spark.read.json(path)).orderBy("ibge_code").collect()]
    assert got == [("0000011", "B", "RO"), ("5101837", "Boa Esperança do Norte", "MT")]


def _write_lines(spark, lines):
    from civigrade.session import scratch_folder

    path = scratch_folder(spark, "lines")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


ROWS = [
    {"sexo": "Total", "ano": "2021", "valor": "10"}, {"sexo": "Total", "ano": "2022", "valor": "20"},
    {"sexo": "Homens", "ano": "2022", "valor": "5"}, {"sexo": "Mulheres", "ano": "2022.0", "valor": "15"},
]


@pytest.mark.parametrize(
    "wanted, latest, values",
    [
        ([RowFilter("sexo", "eq", "total"), RowFilter("ano", "eq", "2022")], None, ["20"]),
        ([RowFilter("sexo", "in", "Homens; Mulheres")], None, ["15", "5"]),
        ([RowFilter("sexo", "neq", "Total")], None, ["15", "5"]),
        ([RowFilter("sexo", "contains", "OMEN")], None, ["5"]),
        ([RowFilter("valor", "gte", "10")], None, ["10", "15", "20"]),
        ([RowFilter("valor", "lte", "10,0")], None, ["10", "5"]),
        ([RowFilter("falta", "neq", "x")], None, ["10", "15", "20", "5"]),
        ([], "ano", ["15", "20", "5"]),
        ([RowFilter("sexo", "eq", "Total")], "ano", ["20"]),
        ([], "sexo", ["10", "20"]),
        ([], "falta", ["10", "15", "20", "5"]),
    ],
)
def test_row_filters(stage_rows, wanted, latest, values):
    kept = filters.apply_filters(
        stage_rows(ROWS), wanted, latest, lambda name: F.try_element_at("raw_row", F.lit(name))
    ).collect()
    assert sorted(r["raw_row"]["valor"] for r in kept) == values


def test_filter_limits(stage_rows):
    with pytest.raises(ValueError):
        filters.filter_staged(stage_rows(ROWS), [])
    many = filters.filter_staged(stage_rows(ROWS), [RowFilter("none", "eq", "")] * 11)
    assert many.count() == len(ROWS)
    with pytest.raises(ValueError):
        RowFilter("a", "like", "x")


def test_period_ranges(spark):
    filters.check_period_range("2020", "2020-03", spark)
    for bad in (("2021", "2020"), ("x", None), (None, "2020-13")):
        with pytest.raises(ValueError):
            filters.check_period_range(*bad, spark)


def test_catalog_search_ranks(spark):
    rows = [("eco01", "Empregos", "Economia", "pessoas"), ("eco02", "Eco viagens", "Economia", "%"), ("pes01", "Economia local", "Pessoas", "%"), ("eco", "X", "", "")]
    catalog = spark.createDataFrame(rows, "code string, name string, dimension string, unit string")
    got = {r["code"]: r["match_rank"] for r in filters.search_catalog_rows(catalog, "eco").collect()}
    assert got == {"eco": 0, "eco01": 1, "eco02": 1, "pes01": 2}
    assert [r["code"] for r in filters.search_catalog_rows(catalog, "ECO pessoas").collect()] and filters.search_catalog_rows(catalog, "").count() == 4


NUMBERS = ["7", "7.", "+7", "7e0", " 7,0 ", "007", "-0", "0", ",5", "-3,25", "1e3", "999", "1000", "1" * 40, "-" + "1" * 40, "s/d", "", None, "1.2.3"]


def test_short_numbers_take_no_key_and_compare_as_keys_do(spark):
    rows = spark.createDataFrame([(v,) for v in NUMBERS], "v string")
    known = {r.v: r.s for r in rows.select("v", short_number(F.col("v")).alias("s")).collect()}
    assert {v for v, s in known.items() if s is not None} == {"7", " 7,0 ", "007", "-0", "0", "-3,25", "999", "1000"}
    keys = {r.v: r.k for r in rows.select("v", filter_key(F.col("v")).alias("k")).collect()}
    for bound in ("7", "7e0", "-0", "1000", "1" * 40):
        for operator in ("gte", "lte"):
            found = filters.apply_filters(rows, [filters.RowFilter("v", operator, bound)])
            holds = lambda k: k is not None and (k >= keys[bound] if operator == "gte" else k <= keys[bound])  # noqa: B023, E731
            assert sorted(r.v for r in found.collect()) == sorted(v for v in NUMBERS if holds(keys[v]))


def test_highest_number_in_any_notation(spark):
    def highest(*values):
        rows = spark.createDataFrame([(v,) for v in values], "v string")
        return sorted((r.v for r in filters.apply_filters(rows, [], "v").collect()), key=repr)

    assert highest("7", "7.", " 7,0", "+7", "6", "x", None) == [" 7,0", "+7", "7", "7."]
    assert highest("7", "1e3", "999") == ["1e3"]
    assert highest("7", "+3", "0") == ["7"]
    assert highest("0", "-0", "-1") == ["-0", "0"]
    assert highest("b", "a", "") == ["b"]
    assert highest("", None) == ["", None]
