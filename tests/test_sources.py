import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from civigrade.operators import profiling
from civigrade.sinks import reports
from civigrade.sources import grid, links, tables


def write(folder: Path, name: str, content: bytes) -> str:
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)
    return str(folder)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_regional_csv_with_mark(spark, tmp_path):
    path = write(tmp_path / "a", "x.csv", "﻿municipio;ano;valor\nCampinas;2023;1.234,50\nSantos;2024;2.345,60\n".encode())
    assert rows(tables.read_csv_table(spark, path), "municipio", "ano", "valor") == [("Campinas", 2023, 1234.5), ("Santos", 2024, 2345.6)]


def test_windows_letters(spark, tmp_path):
    path = write(tmp_path / "a", "x.csv", "município,nota\nSão Paulo,“boa” – 5€\nBelém,x\n".encode("cp1252"))
    assert rows(tables.read_csv_table(spark, path), "municipio", "nota") == [("São Paulo", "“boa” – 5€"), ("Belém", "x")]


@pytest.mark.parametrize("separator", [";", ",", "\t", "|"])
def test_separators_and_quotes(spark, tmp_path, separator):
    text = separator.join(["a", "b", "c"]) + "\n" + separator.join(["1", f'"x{separator}""y"""', "2020-01-05"]) + "\n"
    path = write(tmp_path / "a", "x.csv", text.encode())
    assert rows(tables.read_csv_table(spark, path).withColumn("c", F.col("c").cast("string")), "a", "b", "c") == [(1, f'x{separator}"y"', "2020-01-05")]


def test_wrapped_records(spark, tmp_path):
    birds = ["Arara", "Bem-te-vi", "Canário, belga", "Dançador", "Ema"]
    lines = ["nr,ave,ninhos"] + [f'"{i},""{bird}"",{i * i}"' for i, bird in enumerate(birds)] + ['"9,""nr,ave"",81"', "nr,ave,ninhos"]
    df = tables.read_csv(spark, write(tmp_path / "a", "x.csv", "\r\n".join(lines).encode()))
    expected = [(str(i), bird, str(i * i)) for i, bird in enumerate(birds)] + [("9", "nr,ave", "81"), ("nr", "ave", "ninhos")]
    assert rows(df, "nr", "ave", "ninhos") == expected  # only the first line is the header


def test_wrapped_header_with_quotes(spark, tmp_path):
    lines = ['"peso, kg",ave'] + [f'"""{i},5"",""ema"""' for i in range(6)]
    df = tables.read_csv(spark, write(tmp_path / "a", "x.csv", "\n".join(lines).encode()))
    assert rows(df, "peso, kg", "ave") == [(f"{i},5", "ema") for i in range(6)]


def test_types_are_told_by_every_row(spark, tmp_path):
    late = "k;peso\n" + "".join(f"{i};{3 * i}\n" for i in range(900)) + "900;0.125\n"
    df = tables.read_csv_table(spark, write(tmp_path / "a", "x.csv", late.encode()))
    assert dict(df.dtypes)["peso"] == "double" and df.agg(F.min_by("peso", "k"), F.max_by("peso", "k")).first() == (0.0, 0.125)
    mixed = tables.read_csv_table(spark, write(tmp_path / "b", "x.csv", "altura|tipo\n7,75|x\n0.5|y\n-|z\nsem medida|w\n12|v\n".encode()))
    assert rows(mixed, "altura") == [(7.75,), (0.5,), (None,), (None,), (12.0,)]


def test_long_whole_numbers_stay_exact(spark, tmp_path):
    keys = ["12345678901234567890", "12345678901234567891", "-99999999999999999999999999999999999999"]
    text = "chave;largo;misto\n" + "".join(f"{k};{k}{'7' * 20};{m}\n" for k, m in zip(keys, ["1.5", "12345678901234567890", "2"]))
    df = tables.read_csv_table(spark, write(tmp_path / "a", "x.csv", text.encode()))
    assert dict(df.dtypes) == {"chave": "decimal(38,0)", "largo": "string", "misto": "string", "__file": "string", "__block": "bigint", "__at": "bigint"}
    staged = [r["raw_row"] for r in tables.stage(df, "i", "s").orderBy("row_number").collect()]
    assert [r["chave"] for r in staged] == keys and staged[1]["misto"] == "12345678901234567890"


def test_times_and_truth(spark, tmp_path):
    text = "quando,dia,aberto\n2021-05-06T07:08:09,2021-05-06,true\n2021-05-06 23:59,2020-02-29,false\n"
    df = tables.read_csv_table(spark, write(tmp_path / "a", "x.csv", text.encode()))
    assert [kind for _, kind in df.dtypes[:3]] == ["timestamp_ntz", "date", "boolean"]
    assert [r["raw_row"] for r in tables.stage(df, "i", "s").orderBy("row_number").collect()] == [
        {"quando": "2021-05-06T07:08:09", "dia": "2021-05-06", "aberto": "true"},
        {"quando": "2021-05-06T23:59:00", "dia": "2020-02-29", "aberto": "false"},
    ]


def test_gzip(spark, tmp_path):
    path = write(tmp_path / "a", "x.csv.gz", gzip.compress(b"a;b\n1;2\n3;4\n"))
    assert rows(tables.read_csv_table(spark, path), "a", "b") == [(1, 2), (3, 4)]


def test_files_of_different_layouts(spark, tmp_path):
    """Separator, encoding, header order and line breaks are those of each file."""
    folder = tmp_path / "m"
    write(folder, "1.csv", b"a;b\n1;x\n")
    write(folder, "2.csv", b"b,a\ny,2\n")
    write(folder, "3.csv", "b|a|ção\nmaçã|3|é\n".encode("cp1252"))
    path = write(folder, "4.csv", b'a;b\n4;"two\nlines; ""q"""\n5;z\n')
    df = tables.read_csv(spark, path)
    got = sorted((r["a"], r["b"], r["ção"]) for r in df.select("a", "b", "ção").collect())
    assert got == [("1", "x", None), ("2", "y", None), ("3", "maçã", "é"), ("4", 'two\nlines; "q"', None), ("5", "z", None)]
    assert tables.stage(df, "i", "s").count() == 5
    with pytest.raises(ValueError):
        tables.read_csv(spark, path, most_layouts=3)


def test_codes_become_text(spark):
    df = profiling.normalise_columns(spark.createDataFrame([(3550308.0,), (None,), (110001.0,)], "`Código IBGE` double"))
    assert rows(df, "codigo_ibge") == [("3550308",), (None,), ("110001",)]


def test_json_and_label_rows(spark, tmp_path):
    plain = write(tmp_path / "a", "x.json", json.dumps([{"ilha": "Bela", "ano": 2019, "aves": 7.25}]).encode())
    assert rows(tables.read_json_table(spark, plain), "ilha", "ano", "aves") == [("Bela", 2019, 7.25)]


def test_only_first_records_are_labels(spark, tmp_path):
    label = {"D1": "Ilha (Código)", "V": "Aves"}
    data = [{"D1": "Bela (Código)", "V": "3"}, {"D1": "Grande", "V": "(Código)"}, {"D1": None, "V": "5"}]
    write(tmp_path / "l", "1.json", json.dumps([label, *data]).encode())
    path = write(tmp_path / "l", "2.json", json.dumps([label, *data[:1]]).encode())
    df = tables.read_json(spark, path)
    assert df.columns == ["Ilha (Código)", "Aves"]
    expected = [("Bela (Código)", "3")] * 2 + [("Grande", "(Código)"), (None, "5")]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)
    write(tmp_path / "l", "3.json", json.dumps([{"D1": "Outra (Código)", "V": "x"}, *data]).encode())
    with pytest.raises(ValueError):
        tables.read_json(spark, path)


def test_staged_rows_follow_file_order(spark, tmp_path):
    write(tmp_path / "a", "1.csv", b"v\n" + b"".join(b"%d\n" % i for i in range(1000)))
    path = write(tmp_path / "a", "2.csv", b"v\n" + b"".join(b"%d\n" % i for i in range(1000, 1500)))
    staged = tables.stage(tables.read_csv(spark, path), "i", "s")
    assert [(r["row_number"], int(r["raw_row"]["v"])) for r in staged.orderBy("row_number").collect()] == [(i + 1, i) for i in range(1500)]


def test_label_rows_in_folders_named_by_value(spark, tmp_path):
    label, data = {"D1": "Ilha (Código)", "V": "Aves"}, [{"D1": "7", "V": "1"}, {"D1": "8", "V": "2"}]
    write(tmp_path / "part=0", "1.json", json.dumps([label, data[0]]).encode())
    write(tmp_path / "part=1", "2.json", json.dumps([label, data[1]]).encode())
    found = tables.read_json(spark, str(tmp_path))
    assert found.columns == ["Ilha (Código)", "Aves", "part"]
    assert sorted(rows(found, "Ilha (Código)", "Aves", "part")) == [("7", "1", 0), ("8", "2", 1)]


def test_nested_cells_are_staged_as_json(spark):
    df = spark.createDataFrame([(1.0, float("nan"), [1, 2], {"k": 2.5})], "a double, b double, c array<int>, d map<string,double>")
    assert df.select(profiling.as_staged_cells(df)).first()[0] == {"a": "1", "b": None, "c": "[1,2]", "d": '{"k":2.5}'}


def sheet(spark, *cells, file="f", name="Dados"):
    return spark.createDataFrame([(file, name, i, list(c)) for i, c in enumerate(cells, start=1)], "file string, sheet string, row_number int, cells array<string>")


def table(spark, *cells):
    g = sheet(spark, *cells)
    headers = grid.infer_headers(g)
    return headers.first(), grid.table_rows(g, headers)


def test_grid_skips_titles(spark):
    header, data = table(
        spark, ["Quadro 7: aves por ilha", "__unnamed__1", None, "__UNNAMED__3"], ["em milhares"], [None, "(segue)"],
        ["Ilhas e_x000d_\narqui-\npélagos", "Ordem", "Ninhos_x000d_\n(mil)", "Parte (%)"],
        ["Bela", "1ª", "77.5", "12.25"], ["Grande", "2ª", "60.25", "9.5"],
    )
    assert list(header["header_rows"]) == [4] and data.count() == 2
    assert header["names"] == ["Ilhas e arquipélagos", "Ordem", "Ninhos (mil)", "Parte (%)"]


def test_grid_combines_header_levels(spark):
    header, data = table(spark, ["Censo"], ["Lugar", None, "Contagem", None], ["Ilha", "Praia", "Ninhos", None], ["Bela", "Sul", "4", "1"], ["Grande", "Norte", "5", "2"])
    assert header["names"] == ["Lugar Ilha", "Lugar Praia", "Contagem Ninhos", "Coluna 4"] and header["combined"]
    assert [r["cells"][3] for r in data.orderBy("row_number").collect()] == ["1", "2"]


def test_grid_repeated_headers_notes_and_warnings(spark):
    body = [[f"Ilha {i}", str(1990 + i), str(i * 3)] for i in range(9)]
    cells = [["Contagem nas 40 maiores ilhas"], ["Ilha", "Ano", "Ninhos"], *body[:5], [" ilha", "ANO", "Ninhos "], *body[5:], ["Fonte: censo"]]
    g = sheet(spark, *cells)
    headers = grid.infer_headers(g)
    data = grid.table_rows(g, headers)
    assert data.count() == 9
    warning = grid.quality_warnings(g, data).first()
    assert (warning["promised_rows"], warning["rows"], warning["sparse_columns"]) == (40, 9, 0)
    staged = grid.staged_rows(data).orderBy("row_number").collect()
    assert [r["row_number"] for r in staged] == list(range(1, 10)) and staged[0]["raw_row"]["Ilha"] == "Ilha 0"


def test_grid_keeps_columns_that_fill_late(spark):
    """Values far below the rows that tell the header: titled and untitled columns keep their data."""
    late = 57
    body = [[f"Ilha {i}", str(1950 + i), str(i), "dito" if i == late else None, "88" if i == late else None] for i in range(70)]
    g = sheet(spark, ["Ilha", "Ano", "Ninhos", "Nota", None], *body)
    header = grid.infer_headers(g).first()
    assert header["names"] == ["Ilha", "Ano", "Ninhos", "Nota", "__UNNAMED__4"] and not header["combined"]
    data = grid.table_rows(g, grid.infer_headers(g))
    assert data.count() == 70
    assert [r["cells"][3:] for r in data.collect() if r["cells"][3]] == [["dito", "88"]]
    assert grid.quality_warnings(g, data).first()["sparse_columns"] == 1


def test_grid_sheets_that_begin_late(spark):
    """The first stored row is row 60: with a header, with data at once, and with one column; and a header below 50 titles."""
    late = lambda *cells, name: sheet(spark, *cells, name=name).withColumn("row_number", F.col("row_number") + 59)
    titled = late(["Ilha", "Ano", "Ninhos"], ["Bela", "1990", "3"], ["Grande", "1991", "4"], name="A")
    data = late(["Bela", "1990", "3"], ["Grande", "1991", "4"], name="B")
    single = late(["x"], ["y"], name="C")
    below = sheet(spark, *[["nota", None, None]] * 50, ["Ilha", "Ano", "Ninhos"], ["Bela", "1990", "3"], name="D")
    g = titled.unionByName(data).unionByName(single).unionByName(below)
    headers = {h["sheet"]: h for h in grid.infer_headers(g).collect()}
    assert sorted(headers) == ["A", "B", "C", "D"]
    assert headers["A"]["names"] == headers["D"]["names"] == ["Ilha", "Ano", "Ninhos"]
    assert headers["A"]["first_data"] == 61 and headers["D"]["first_data"] == 52
    found = grid.table_rows(g, grid.infer_headers(g)).groupBy("sheet").count().collect()
    assert {r["sheet"]: r["count"] for r in found} == {"A": 2, "B": 2, "C": 2, "D": 1}


def test_titled_column_without_any_value(spark):
    header, data = table(spark, ["Ilha", "Ano", "Ninhos", "Nota"], ["Bela", "1990", "3"], ["Grande", "1991", "4"])
    assert header["names"] == ["Ilha", "Ano", "Ninhos", "Nota"]
    assert [r["cells"] for r in data.orderBy("row_number").collect()] == [["Bela", "1990", "3", None], ["Grande", "1991", "4", None]]


def test_equal_sheets_go_to_the_first(spark):
    one = sheet(spark, ["a", "b"], ["x", "y"], ["z", "w"], name="Zeta").withColumn("sheet_position", F.lit(1))
    two = sheet(spark, ["a", "b"], ["x", "y"], ["z", "w"], name="Alfa").withColumn("sheet_position", F.lit(2))
    g = one.unionByName(two)
    data = grid.table_rows(g.drop("sheet_position"), grid.infer_headers(g))
    assert grid.largest_sheet(data).first()["sheet"] == "Alfa"
    placed = data.join(g.select("file", "sheet", "sheet_position").distinct(), ["file", "sheet"])
    assert grid.largest_sheet(placed).first()["sheet"] == "Zeta"


def test_grid_text_tables_and_missing_headers(spark):
    header, data = table(spark, ["Lista"], ["UF", "Nome"], ["SP", "São Paulo"], ["RJ", "Rio"])
    assert list(header["header_rows"]) == [2] and header["names"] == ["UF", "Nome"] and data.count() == 2
    header, data = table(spark, ["a", "1", "2"], ["b", "3", "4"])
    assert list(header["header_rows"]) == [] and data.count() == 1


def test_sheet_choice(spark):
    small = sheet(spark, ["a", "b"], ["x", "y"], name="Um")
    big = sheet(spark, ["a", "b", "c"], ["x", "y", "z"], ["x", "y", "z"], name="Dois")
    skip = sheet(spark, ["1", "2", "3"], name=" SUMÁRIO ")
    g = small.unionByName(big).unionByName(skip)
    assert sorted(rows(grid.sheet_sizes(g), "sheet", "rows", "columns")) == [("Dois", 3, 3), ("Um", 2, 2)]
    named = grid.sheet_sizes(g).select("file", "sheet")
    kept = g.join(named, ["file", "sheet"])
    assert grid.largest_sheet(grid.table_rows(kept, grid.infer_headers(kept))).first()["sheet"] == "Dois"


PAGE = "https://www.gov.br/inep/pt-br/dados/indice.html?x=1"


@pytest.mark.parametrize(
    "reference, expected",
    [
        ("a.csv", "https://www.gov.br/inep/pt-br/dados/a.csv"), ("../b/./c.zip", "https://www.gov.br/inep/pt-br/b/c.zip"), ("/raiz.csv", "https://www.gov.br/raiz.csv"),
        ("//outro.org/x.json", "https://outro.org/x.json"), ("?y=2", "https://www.gov.br/inep/pt-br/dados/indice.html?y=2"), ("#fim", PAGE + "#fim"), ("", PAGE),
        ("mailto:a@b", "mailto:a@b"), ("HTTP://x.y/z.csv", "HTTP://x.y/z.csv"), ("../../../../../x.csv", "https://www.gov.br/x.csv"), ("sub/", "https://www.gov.br/inep/pt-br/dados/sub/"),
    ],
)
def test_urls(cells, reference, expected):
    assert cells(lambda c: links.resolve_url(F.lit(PAGE), c), [reference]) == [expected]


def test_download_links(spark):
    html = """<!-- <a href="no.csv"> --><a class='x' href='/inep/dados/a.csv'>a</a> <a href="/outra/secao/b.csv">b</a><a data-href="c.csv">c</a>
    <A HREF=https://ftp.org/d.XLSX>d</A><a href="e.html">e</a><a title="a > b" href="f.zip?x=1&amp;y=2">f</a><a href="f.zip?x=1&amp;y=2">f</a><script>var a='<a href="g.csv">';</script>
    <a href="ftp://h.org/h.csv">h</a>"""
    page = spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string")
    got = [(r["name"], r["link"]) for r in links.download_links(page).orderBy("position").collect()]
    assert got == [
        ("a.csv", "https://www.gov.br/inep/dados/a.csv"), ("d.XLSX", "https://ftp.org/d.XLSX"), ("f.zip", "https://www.gov.br/inep/pt-br/dados/f.zip?x=1&y=2"),
    ]


def test_all_links_unless_a_number_is_asked_for(spark):
    html = "".join(f'<a href="{i}.csv">x</a>' for i in range(50))
    page = spark.createDataFrame([(1, "http://a.b/c/", html)], "page_id long, url string, html string")
    names = lambda **most: [r["name"] for r in links.download_links(page, **most).orderBy("position").collect()]
    assert names() == [f"{i}.csv" for i in range(50)] and names(most=20) == [f"{i}.csv" for i in range(20)]


def test_first_source_with_candidates(spark):
    rows = [(1, "page", 3, "a"), (1, "folder", 2, "b"), (1, "folder", 2, "c"), (2, "page", 3, "d"), (None, "page", 3, "e")]
    got = links.first_source(spark.createDataFrame(rows, "k long, source string, place int, link string"), ["k"], "source", "place")
    assert sorted(((r["k"], r["link"]) for r in got.collect()), key=repr) == [(1, "b"), (1, "c"), (2, "d"), (None, "e")]


def test_bot_challenges(cells):
    pages = ["<title>Just a moment...</title>", "x" * 5000 + "Just a moment", "ok"]
    assert cells(links.is_bot_challenge, pages) == [True, True, False]
    assert cells(lambda c: links.is_bot_challenge(c, 4096), pages) == [True, False, False]


def test_report_cells(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "Campinas", 71.25), (2, "Santos", None), (3, "=SOMA(A1)", -3.0), (4, 'diz "oi"; x', float("nan")), (5, "-", 12345678.9)], "i int, `Município` string, Nota double"
    )
    path = str(tmp_path / "report")
    reports.write_report(df, path, ["i"], ["Linha", "Município", "Nota"])
    content = "".join(p.read_bytes().decode() for p in sorted(Path(path).glob("part-*.txt")))
    assert content == (
        "﻿Linha;Município;Nota\r\n1;Campinas;71,25\r\n2;Santos;\r\n3;'=SOMA(A1);-3\r\n" '4;"diz ""oi""; x";\r\n' "5;'-;12345678,9\r\n"
    )


def test_export_columns_in_first_seen_order(spark, stage_rows, tmp_path):
    first = stage_rows([{}], sheet="A").withColumn("raw_row", F.expr("map('b', '1', 'a', '2')"))
    second = stage_rows([{}], sheet="A").withColumn("raw_row", F.expr("map('a', '3', 'aba', 'x')")).withColumn("row_number", F.lit(2).cast("long"))
    both = first.unionByName(second).unionByName(stage_rows([{"c": "y", "b": None}], sheet="B"))
    out = reports.export_rows(both)
    assert out.columns == ["aba_2", "b", "a", "aba", "c"] and out.count() == 3
    reports.write_export(both, str(tmp_path / "export"))
    content = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "export").glob("part-*.txt")))
    assert content == "﻿aba_2;b;a;aba;c\r\nA;1;2;;\r\nA;;3;x;\r\nB;;;;y\r\n"


def profile(spark, *columns, samples=None):
    data = [("i", "s", p, n, (samples or {}).get(n, [])) for p, n in enumerate(columns, start=1)]
    return spark.createDataFrame(data, "import_id string, sheet_name string, position int, column_name string, sample array<string>")


def test_mapping_suggestions(spark):
    got = profiling.suggest_mapping(profile(spark, "codigo_ibge", "municipio", "ano", "valor", "percentual")).first()
    assert (got["municipality_code"], got["municipality_name"], got["reference_year"], got["value"]) == ("codigo_ibge", "municipio", "ano", "percentual")
    ranking = profiling.suggest_mapping(profile(spark, "posicao_ocupada_pelos_100_maiores_municipios", "numero_de_municipios")).first()
    assert ranking["municipality_name"] is None


def test_recommendations(spark):
    names = ["codigo_municipio", "janeiro_2020_saldos", "fevereiro_2020_saldos", "saldos_total", "admissoes"]
    got = {r["code"]: r["value_field"] for r in profiling.recommend_indicators(profile(spark, *names)).collect()}
    assert got == {"caged_saldo_empregos": "fevereiro_2020_saldos", "caged_admissoes": "admissoes"}
    power = profiling.recommend_indicators(profile(spark, "x", "potencia_outorgada_kw", "potencia_kw")).collect()
    assert [(r["code"], r["value_field"]) for r in power] == [("potencia_geracao_instalada", "potencia_outorgada_kw")]


def test_period_suggestions(spark):
    mode = lambda *names, **s: tuple(profiling.suggest_period(profile(spark, *names, samples=s)).first())[2:]
    assert mode("ano", "mes") == ("month_year_columns", "month", "ano", "mes", None)
    assert mode("exercicio") == ("year_column", "year", "exercicio", None, None)
    assert mode("competencia") == ("date_column", "month", None, None, "competencia")
    assert mode("mes", mes=["jan/2020", "02/2020", "2020-03", "Março/2020", "total"]) == ("date_column", "month", None, None, "mes")
    assert mode("mes", mes=["jan/2020", "x", "y"])[0] == "fixed" and mode("valor")[0] == "fixed"


def test_measure_groups(spark):
    got = profiling.period_measure_groups(profile(spark, "fev_2020_saldo", "jan_2020_saldo", "jan_2020_outro", "2020", "2019", "x")).orderBy("granularity").collect()
    assert [(r["granularity"], r["label"], list(r["fields"]), r["first_period"], r["last_period"]) for r in got] == [
        ("month", "saldo", ["jan_2020_saldo", "fev_2020_saldo"], "01/2020", "02/2020"), ("year", "valor", ["2019", "2020"], "2019", "2020"),
    ]


def test_profile_of_staged_rows(stage_rows):
    df = stage_rows([{"a": "1", "b": "x", "c": None}, {"a": "2", "b": None}])
    got = profiling.with_positions(profiling.profile_staged(df)).orderBy("position").collect()
    assert [(r["column_name"], r["dtype"], r["rows"], r["null_count"], r["sample"]) for r in got] == [
        ("a", "bigint", 2, 0, ["1", "2"]), ("b", "string", 2, 1, ["x", None]), ("c", "string", 2, 2, [None]),
    ]
