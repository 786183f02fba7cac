from decimal import Decimal

import pytest

from civigrade.functions import naming, periods, scoring, text, values
from civigrade.functions.periods import PeriodSelection


def _period(p):
    return None if p is None else (p["year"], p["month"])


def test_regional_numbers(cells):
    spelled = ["12,5%", "1.234,56", "1,234.5", "1e-05", "1.234", "1,234", " 12 345,6", "-0,50", "abc", "true", "1,2,3", "", None, "1,234,567"]
    expected = ["12.5", "1234.56", "1234.5", "0.00001", "1234", "1.234", "12345.6", "-0.5", None, None, None, None, None, "1234567"]
    got = cells(values.parse_number, spelled)
    assert got == [None if e is None else Decimal(e) for e in expected]
    assert cells(lambda c: values.number_text(values.parse_number(c)), ["1.234,50", "100", "0", "-0,5"]) == ["1234.5", "100", "0", "-0.5"]


def test_us_first_numbers(cells):
    got = cells(values.parse_number_us_first, ["1,234", "1.234,5", "12 %", ".5", "1e3", "9" * 65, "5,25"])
    assert got == [Decimal("1234"), Decimal("1234.5"), Decimal("12"), Decimal("0.5"), None, None, Decimal("5.25")]


def test_wide_and_filter_numbers(cells):
    assert cells(values.parse_wide_number, ["1.234,5%", "12.5", "1,5", "x", "1.5.5"]) == [Decimal("1234.5"), Decimal("12.5"), Decimal("1.5"), None, None]
    assert cells(values.filter_number, ["10,5", "NaN", "Infinity", " 3 ", "1e2"]) == [Decimal("10.5"), None, None, Decimal("3"), Decimal("100")]
    assert cells(values.looks_numeric, ["1.234,5", "1,234.5", "12", "+.5", "1e5", "x", "", None]) == [True, True, True, True, True, False, False, False]


def test_ratio_and_clamp(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        values.ratio(F.lit(123.4), F.lit(1234), 100).alias("r"), values.ratio(F.lit(1), F.lit(0)).alias("zero"),
        values.clamp(F.lit(408.87), None, 100.0).alias("high"), values.clamp(F.lit(-3.0), 0.0).alias("low"),
        values.clamp(F.lit(None).cast("double"), 0.0, 1.0).alias("none"),
    ).first()
    assert (round(row["r"], 9), row["zero"], row["high"], row["low"], row["none"]) == (10.0, None, 100.0, 0.0, None)


def test_date_periods(cells):
    spelled = ["2024-03-01", "15/07/2023", "03/2024", "jan/2024", "Março de 2024", "set-24", "202407", "2024", "2024-03-01T10:00", "2023.0", "abc", "2024-13-01", "", None, "1850", "13/2024"]
    expected = [(2024, 3), (2023, 7), (2024, 3), (2024, 1), (2024, 3), (2024, 9), (2024, 7), (2024, None), (2024, 3), None, None, None, None, None, None, None]
    assert [_period(p) for p in cells(periods.parse_date_period, spelled)] == expected


def test_years_and_months(cells):
    assert cells(periods.parse_year, ["2023.0", "23", "1800", "2201", "1900", "2023,00"]) == [2023, None, None, None, 1900, 2023]
    assert cells(periods.parse_month, ["1", "12", "3.0", "Jan", "março", "fev.", "13", "x", "0"]) == [1, 12, 3, 1, 3, 2, None, None, None]


def test_title_periods(cells):
    build = periods.title_period
    assert [_period(p) for p in cells(build, ["jul_2024_saldo", "primar_2020", "valor_2021", "Março/2020 Saldos", "x"])] == [
        (2024, 7), (2020, None), (2021, None), (2020, 3), None,
    ]
    assert [_period(p) for p in cells(build, [" MARÇO_2019 ", "Valor 2022", "JUN/2018", "2017"])] == [(2019, 3), (2022, None), (2018, 6), (2017, None)]
    spelled = ["julho_2026_saldos", "jul_2026", "julho_1999", "JULHO_2020_saldos", "Março 2021"]
    assert [_period(p) for p in cells(periods.legacy_month_title, spelled)] == [(2026, 7), None, None, (2020, 7), (2021, 3)]


def test_period_bounds_and_labels(cells, spark):
    from pyspark.sql import functions as F

    lower = cells(lambda c: periods.period_bound(c, False).cast("string"), ["2024", "2024-02", "2024-02-10", "2024-13", "x"])
    upper = cells(lambda c: periods.period_bound(c, True).cast("string"), ["2024", "2024-02", "2024-02-10", "2024-02-30", "2023-02"])
    assert lower == ["2024-01-01", "2024-02-01", "2024-02-10", None, None]
    assert upper == ["2024-12-31", "2024-02-29", "2024-02-10", None, "2023-02-28"]
    day = F.lit("2024-03-01").cast("date")
    row = spark.range(1).select(periods.period_label(day, F.lit(True)), periods.period_label(day, F.lit(False))).first()
    assert tuple(row) == ("mar. de 2024", "2024")
    assert cells(periods.value_granularity, ["2024-03-01", "2024-03-02", None]) == ["month", "year", "year"]
    assert cells(periods.frequency_granularity, ["Mensal", "anual", "eventual", None]) == ["month", "year", None, None]


@pytest.mark.parametrize(
    "selection, expected",
    [
        (PeriodSelection("year_column", year_field="ano"), (2023, None)),
        (PeriodSelection("month_year_columns", "month", year_field="ano", month_field="mes"), (2023, 3)),
        (PeriodSelection("date_column", "month", date_field="data"), (2024, 5)),
        (PeriodSelection("date_column", "year", date_field="data"), (2024, None)),
        (PeriodSelection("date_column", "month", date_field="ano"), None),
        (PeriodSelection("fixed", "month", fixed_year=2020, fixed_month=2), (2020, 2)),
        (PeriodSelection("prepared", "month"), (2022, 7)),
        (PeriodSelection("prepared", "year"), (2022, None)),
    ],
)
def test_period_modes(spark, selection, expected):
    from pyspark.sql import functions as F

    row = spark.createDataFrame(
        [("2023", "março", "05/2024", "2022-07-01", "2021")], "ano string, mes string, data string, reference_period string, reference_year string"
    )
    assert _period(row.select(periods.row_period(F.col, selection)[0].alias("p")).first()["p"]) == expected


def test_incomplete_period_selections_are_refused():
    for bad in ({"mode": "year_column"}, {"mode": "fixed", "fixed_year": 1800}, {"mode": "fixed", "granularity": "month", "fixed_year": 2020}, {"mode": "other"}):
        with pytest.raises(ValueError):
            PeriodSelection(**bad)


def test_scores(spark):
    from pyspark.sql import functions as F

    cases = [
        (50.0, "direct", 0.0, 100.0, None, 50.0), (20.0, "inverse", 0.0, 100.0, None, 80.0), (4.0, "checklist", None, None, 5.0, 80.0),
        (500.0, "direct", 0.0, 100.0, None, 100.0), (1.0, "direct", 5.0, 5.0, None, None), (1.0, "manual", 0.0, 9.0, None, None),
        (1.0, "checklist", 0.0, 9.0, None, None), (None, "direct", 0.0, 1.0, None, None), (None, "checklist", 0.0, 1.0, 2.0, None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v double, d string, lo double, hi double, m double, want double")
    score = scoring.indicator_score(*[F.col(c) for c in ("v", "d", "lo", "hi", "m")])
    assert [r["s"] for r in rows.orderBy("i").select(score.alias("s")).collect()] == [c[-1] for c in cases]


def test_maturity_and_profiles(cells):
    got = cells(lambda c: scoring.maturity(c.cast("double")), ["0", "20", "20.1", "60", "100", None])
    assert got == ["Nível 1 - Inicial", "Nível 1 - Inicial", "Nível 2 - Em desenvolvimento", "Nível 3 - Estruturado", "Nível 5 - Otimizado", None]
    people = ["50000", "50001", "300000", "300001", "1000000", "1000001", "0", None]
    assert cells(lambda c: scoring.city_profile(c.cast("long")), people) == ["pequeno", "medio", "medio", "grande", "grande", "metropole", None, None]


def test_place_names(cells):
    spelled = ["Campinas (SP)", "Ro-Ji-Parana", "Pau d Arco - PA", "Belém/PA", "Ji-Paraná", "Xique-Xique", "campinas (sp)"]
    got = [None if p is None else (p["name"], p["state"]) for p in cells(text.parse_place_name, spelled)]
    assert got == [("Campinas", "SP"), ("Ji-Parana", "RO"), ("Pau d Arco", "PA"), ("Belém", "PA"), None, None, ("campinas", "SP")]
    assert cells(text.place_name_key, ["  SÃO   Paulo ", "Pau d'Arco"]) == ["sao paulo", "pau d arco"]


def test_codes_and_prefixes(cells):
    assert cells(text.short_code, ["eco01_empregos", "ECO11", "caged_saldo", "abc12"]) == ["ECO01", "ECO11", "CAGED_SALDO", "ABC12"]
    assert cells(text.dimension_prefix, ["Economia", " GOV ", "Governança", "Infraestrutura digital e dados", "Outra"]) == ["eco", "gov", "gov", "idd", None]


def test_column_names(cells):
    raw = ["  Código IBGE ", "Preço/Total", "valor_duplicated_0", "Ação  de\tTeste", ""]
    expected = ["codigo_ibge", "preco_total", "valor_2", "acao_de_teste", ""]
    assert cells(naming.column_name, raw) == expected


def test_unique_names(spark):
    assert naming.unique_names(spark, ["a", "", "a", "a_2", "a"]) == ["a", "coluna_2", "a_2", "a_2_2", "a_3"]
    assert naming.unique_names(spark, ["", "", "coluna_1"]) == ["coluna_1", "coluna_2", "coluna_1_2"]
    assert naming.unique_names(spark, ["b_2", "b", "b"], "x ", " (", ")") == ["b_2", "b", "b (2)"]
    assert naming.canonical_names(spark, ["Ação/X", "__UNNAMED__3", " ação x", "v_duplicated_0"]) == ["acao_x", "coluna_2", "acao_x_2", "v_2"]
    assert naming.unique_names(spark, []) == []


def test_column_classes(cells):
    assert cells(naming.is_municipality_column, ["municipio", "codigo_municipal", "numero_de_municipios", "total_municipio", "valor"]) == [True, True, False, False, False]
    assert cells(naming.is_monthly_column, ["jul_2024_saldo", "primar_2020", "Março_2020"]) == [True, False, True]
    assert cells(naming.is_annual_column, ["valor_2021", "jul_2024", "posicao_2020", "x_2020_y"]) == [True, False, False, True]


def test_period_measures(cells):
    got = cells(naming.period_measure, ["julho_2026_saldos", "saldos_2020", "2021", "valor", "a_jan_2020_b"])
    assert [None if g is None else (g["measure"], g["year"], g["month"]) for g in got] == [
        ("saldos", 2026, 7), ("saldos", 2020, None), ("", 2021, None), None, ("a_b", 2020, 1),
    ]


def test_number_cell_text(cells):
    got = cells(text.number_cell_text, [2022.0, 2.5, 12345678.9, 0.00001, float("nan"), float("inf"), None, -3.0], "v double")
    assert got == ["2022", "2.5", "12345678.9", "0.00001", "", "", "", "-3"]


def test_merged_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), ({"a": "1"}, None)], "raw map<string,string>, norm map<string,string>")
    merged = [r[0] for r in rows.select(text.merged_row(F.col("raw"), F.col("norm"))).collect()]
    assert merged == [{"a": "1", "b": "3", "c": None}, {"a": "1"}]
    field = [r[0] for r in rows.select(text.merged_field(F.col("raw"), F.col("norm"), "b")).collect()]
    assert field == ["3", None]


def test_exact_numbers(cells):
    """Every digit stays; against Python's decimals."""
    from decimal import Decimal

    plain = ["1e-12", "-1E-12", "12345678901234567890123456789", "0.10", "000.5e1", "-0", "1.234,5600", "1,234,567.25", "12,5%", ".5", "5.", "1e400", "-7e-399", "0e5"]
    expected = ["0.000000000001", "-0.000000000001", "12345678901234567890123456789", "0.1", "5", "0", "1234.56", "1234567.25", "12.5", "0.5", "5", "1" + "0" * 400, "-0." + "0" * 398 + "7", "0"]
    assert cells(values.exact_number, plain) == expected
    assert cells(values.exact_number, ["abc", "", None, "1e401", "1e99999999999", "1.2.3"]) == [None] * 6
    assert cells(lambda c: values.fits(values.exact_number(c)), ["1e-10", "1e-11", "1" * 28, "1" * 29]) == [True, False, True, False]
    texts = ["-100", "-99.5", "-1.5", "-1.25", "-1", "-1e-12", "0", "1e-13", "1e-12", "0.5", "1", "1.25", "1.5", "9", "10", "99999999999999999999999999999", "1e30"]
    keys = cells(values.filter_key, texts)
    assert keys == sorted(keys) and len(set(keys)) == len(keys) and [Decimal(t) for t in texts] == sorted(Decimal(t) for t in texts)
    assert cells(values.filter_key, ["1,50", "+1.5"]) == [keys[12]] * 2
