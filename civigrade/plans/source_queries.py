"""Source, grid, profile and link queries. Files are first written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civigrade.functions import naming
from civigrade.operators import geography, profiling
from civigrade.operators.joins import number_rows
from civigrade.plans import model
from civigrade.plans.registry import Registry
from civigrade.session import scratch_folder
from civigrade.sinks import reports
from civigrade.sources import grid, links, tables

query = Registry()


def _plain_orders(spark, folder):
    """Orders as a file would hold them: accented names, regional numbers, a code column with fractions."""
    return model.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("Número"), F.concat(F.col("o_custkey") % 10 + 3550300, F.lit(".0")).alias("Código IBGE"),
        model.br_text(F.col("o_totalprice")).alias("Preço/Total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Data"),
        F.concat(F.lit('São "'), "o_orderstatus", F.lit('"; ok')).alias("Situação"),
    )


CSV_SQL = """SELECT o_orderkey AS numero, CAST(o_custkey % 10 + 3550300 AS VARCHAR) AS codigo_ibge, o_totalprice AS preco_total,
  strftime(o_orderdate, '%Y-%m-%d') AS data, 'São "' || o_orderstatus || '"; ok' AS situacao FROM orders"""


def _csv_query(**options):
    def run(spark, folder):
        path = scratch_folder(spark, "csv")
        _plain_orders(spark, folder).write.options(header=True, sep=";", escape='"', **options).csv(path)
        read = tables.read_csv_table(spark, path)
        return read.select("numero", "codigo_ibge", "preco_total", F.col("data").cast("string").alias("data"), "situacao")

    return run


query("s1_n1_n3_n4_csv", CSV_SQL)(_csv_query())
query("s1_latin_csv", CSV_SQL)(_csv_query(encoding="ISO-8859-1"))
query("s5_gzip_csv", CSV_SQL)(_csv_query(compression="gzip"))


@query(
    "s1_mixed_folder",
    """SELECT o_orderkey AS chave, o_orderstatus AS situacao, o_totalprice AS preco,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority || ' ção' END AS atendente FROM orders""",
)
def mixed_folder(spark, folder):
    """Three layouts in one folder: other separator, other column order, other encoding and a column of its own."""
    path = scratch_folder(spark, "mixed")
    orders = model.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("chave"), F.col("o_orderstatus").alias("situacao"), F.col("o_totalprice").alias("preco"), F.concat("o_orderpriority", F.lit(" ção")).alias("atendente")
    )
    layouts = ((["chave", "situacao", "preco"], ";", "UTF-8"), (["preco", "chave", "situacao"], ",", "UTF-8"), (["atendente", "situacao", "preco", "chave"], "|", "ISO-8859-1"))
    for part, (columns, separator, encoding) in enumerate(layouts):
        orders.filter(F.col("chave") % 3 == part).select(*columns).write.options(header=True, sep=separator, encoding=encoding).mode("append").csv(path)
    return tables.read_csv_table(spark, path).select("chave", "situacao", "preco", "atendente")


@query("s1_multiline_cells", """SELECT o_orderkey AS chave, o_orderpriority || chr(10) || 'diz "sim"; ' || o_orderstatus AS nota FROM orders""")
def multiline_cells(spark, folder):
    path = scratch_folder(spark, "multiline")
    note = F.concat("o_orderpriority", F.lit('\ndiz "sim"; '), "o_orderstatus")
    model.table(spark, folder, "orders").select(F.col("o_orderkey").alias("chave"), note.alias("nota")).write.options(header=True, sep=";", escape='"').csv(path)
    return tables.read_csv_table(spark, path).select("chave", "nota")


@query(
    "s1_repeated_headers",
    """SELECT o_orderkey AS valor, o_custkey AS valor_2, CASE o_orderkey % 3 WHEN 1 THEN o_orderstatus || chr(10) || 'x' ELSE o_orderstatus END AS valor_3 FROM orders""",
)
def repeated_headers(spark, folder):
    """One header name three times, in three layouts: plain, with line breaks in cells, and records wrapped in quotes."""
    path = scratch_folder(spark, "repeated")
    key, customer, status = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    broken = F.concat(F.lit('"'), status, F.lit('\nx"'))
    separators = (";", "|", ",")
    for part, cell in enumerate((status, broken, status)):
        separator = F.lit(separators[part])
        line = F.concat(key, separator, customer, separator, cell)
        line = F.concat(F.lit('"'), line, F.lit('"')) if part == 2 else line
        header = separators[part].join(("valor", "valor", "Valor"))
        lines = model.table(spark, folder, "orders").filter(F.col("o_orderkey") % 3 == part).select(line.alias("line"))
        spark.sql(f"SELECT '{header}' AS line").unionByName(lines.coalesce(1)).coalesce(1).write.mode("append").text(path)
    return tables.read_csv_table(spark, path).select("valor", "valor_2", "valor_3")


@query(
    "s1_s6_one_broken_file",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, CAST(o_orderkey AS VARCHAR) AS chave, o_orderpriority || chr(10) || 'diz "sim"; ' || o_orderstatus AS nota
FROM orders""",
)
def one_broken_file(spark, folder):
    """All orders in one file with a line break in every record, read block by block and numbered in file order."""
    path = scratch_folder(spark, "broken")
    note = F.concat("o_orderpriority", F.lit('\ndiz "sim"; '), "o_orderstatus")
    orders = model.table(spark, folder, "orders").select(F.col("o_orderkey").alias("chave"), note.alias("nota"))
    orders.coalesce(1).sortWithinPartitions("chave").write.options(header=True, sep=";", escape='"').csv(path)
    staged = tables.stage(tables.read_csv(spark, path), "i", "s")
    return staged.select("row_number", F.col("raw_row")["chave"].alias("chave"), F.col("raw_row")["nota"].alias("nota"))


@query("s1_long_keys", "SELECT '9' || lpad(CAST(o_orderkey AS VARCHAR), 24, '0') AS chave, o_totalprice AS preco FROM orders")
def long_keys(spark, folder):
    """Whole numbers of 25 digits that differ in the last ones."""
    path = scratch_folder(spark, "long")
    key = F.concat(F.lit("9"), F.lpad(F.col("o_orderkey").cast("string"), 24, "0"))
    model.table(spark, folder, "orders").select(key.alias("chave"), F.col("o_totalprice").alias("preco")).write.options(header=True, sep=",").csv(path)
    staged = tables.stage(tables.read_csv_table(spark, path), "i", "s")
    return staged.select(F.col("raw_row")["chave"].alias("chave"), F.col("raw_row")["preco"].cast("double").alias("preco"))


@query("s2_wrapped_csv", "SELECT o_orderkey AS fid, o_orderstatus || ', \"x\"' AS nm, o_totalprice AS valor FROM orders")
def wrapped_csv(spark, folder):
    path = scratch_folder(spark, "wrapped")
    quoted = F.concat(F.lit('""'), "o_orderstatus", F.lit(', """"x""""""'))
    line = F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit(","), quoted, F.lit(","), F.col("o_totalprice").cast("string"), F.lit('"'))
    lines = model.table(spark, folder, "orders").select(line.alias("fid,nm,valor"))
    lines.write.options(header=True, sep="\u0001", quote="", escapeQuotes=False).csv(path)
    return tables.read_csv_table(spark, path).select("fid", "nm", "valor")


def _json_files(spark, folder, label: str = ""):
    """One JSON array per file, 50,000 orders in each."""
    path = scratch_folder(spark, "json")
    record = F.to_json(F.struct(F.col("o_orderkey").alias("D1C"), F.col("o_orderstatus").alias("D1N"), F.col("o_totalprice").cast("string").alias("V")))
    files = model.table(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / 50_000).alias("part")).agg(
        F.concat(F.lit("[" + label), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value")
    )
    files.write.partitionBy("part").text(path)
    return path


JSON_SQL = "SELECT o_orderkey AS {0}, o_orderstatus AS {1}, o_totalprice AS {2} FROM orders"


@query("s3_json_array", JSON_SQL.format("d1c", "d1n", "v"))
def json_array(spark, folder):
    return tables.read_json_table(spark, _json_files(spark, folder)).select("d1c", "d1n", F.col("v").cast("double").alias("v"))


@query("s4_labelled_json", JSON_SQL.format("numero_codigo", "situacao", "valor"))
def labelled_json(spark, folder):
    label = '{"D1C":"Número (Código)","D1N":"Situação","V":"Valor"},'
    read = tables.read_json(spark, _json_files(spark, folder, label))
    return read.select(
        F.col("Número (Código)").cast("long").alias("numero_codigo"), F.col("Situação").alias("situacao"), F.col("Valor").cast("double").alias("valor")
    )


@query("s4_label_like_data", "SELECT o_orderkey AS chave, o_orderstatus || ' (Código)' AS situacao FROM orders")
def label_like_data(spark, folder):
    """Every record looks like a label record; only the first of each file is one."""
    path = scratch_folder(spark, "labels")
    record = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("D1C"), F.concat("o_orderstatus", F.lit(" (Código)")).alias("V")))
    label = '{"D1C":"Chave","V":"Situação (Código)"}'
    files = model.table(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / 50_000).alias("part")).agg(
        F.concat(F.lit(f"[{label},"), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value")
    )
    files.write.partitionBy("part").text(path)
    return tables.read_json(spark, path).select(F.col("Chave").cast("long").alias("chave"), F.col("Situação (Código)").alias("situacao"))


@query(
    "s6_stage",
    """SELECT 'imp' AS import_id, 'Dados' AS sheet_name, row_number() OVER (ORDER BY o_orderkey) AS row_number, CAST(o_orderkey AS VARCHAR) AS numero,
  printf('%.2f', o_totalprice) AS preco FROM orders""",
)
def stage(spark, folder):
    path = scratch_folder(spark, "stage")
    orders = model.table(spark, folder, "orders").orderBy("o_orderkey")
    orders.select(F.col("o_orderkey").alias("numero"), F.format_string("%.2f", "o_totalprice").alias("preco")).write.options(header=True, sep="|").csv(path)
    staged = tables.stage(tables.read_csv(spark, path), "imp", "Dados")
    cell = lambda name: F.try_element_at("raw_row", F.lit(name))
    return staged.select("import_id", "sheet_name", "row_number", cell("numero").alias("numero"), cell("preco").alias("preco"))


@query(
    "s6_written_sheets",
    f"WITH {model.STAGED_SQL} SELECT import_id, sheet_name, count(*) AS row_count, 5 AS column_count FROM staged GROUP BY 1, 2",
)
def written_sheets(spark, folder):
    path = scratch_folder(spark, "staged")
    tables.write_staged(model.staged(spark, folder), path)
    return tables.sheet_records(spark.read.parquet(path))


@query(
    "s9_u1_export",
    """SELECT 'orders' AS aba_2, 'x' AS aba, CAST(o_orderkey AS VARCHAR) AS chave, o_orderstatus AS situacao, CAST(NULL AS VARCHAR) AS nome FROM orders
UNION ALL SELECT 'parts', NULL, CAST(p_partkey AS VARCHAR), NULL, p_name FROM part""",
)
def export(spark, folder):
    """Two sheets with different columns, one of which is called like the sheet column."""
    return reports.export_rows(_export_staged(spark, folder))


@query(
    "s9_written_export",
    """SELECT 'orders;x;' || o_orderkey || ';' || o_orderstatus || ';' AS line FROM orders
UNION ALL SELECT 'parts;;' || p_partkey || ';;' || p_name FROM part UNION ALL SELECT 'aba_2;aba;chave;situacao;nome'""",
)
def written_export(spark, folder):
    """The lines of the written export, with its header."""
    path = scratch_folder(spark, "export")
    reports.write_export(_export_staged(spark, folder), path)
    return spark.read.option("lineSep", reports.LINE_END).text(path).select(F.ltrim("value", F.lit("﻿")).alias("line"))


def _export_staged(spark, folder):
    orders = model.table(spark, folder, "orders").select(
        F.lit("orders").alias("sheet_name"), F.col("o_orderkey").alias("row_number"),
        F.create_map(F.lit("aba"), F.lit("x"), F.lit("chave"), F.col("o_orderkey").cast("string"), F.lit("situacao"), F.col("o_orderstatus")).alias("raw_row"),
    )
    parts = model.table(spark, folder, "part").select(
        F.lit("parts").alias("sheet_name"), F.col("p_partkey").alias("row_number"),
        F.create_map(F.lit("nome"), F.col("p_name"), F.lit("chave"), F.col("p_partkey").cast("string")).alias("raw_row"),
    )
    return orders.unionByName(parts)


REPORT_CELL = r"""CASE WHEN regexp_matches({0}, '^[=+\-@\t\r]') THEN '''' || {0} ELSE {0} END"""


@query(
    "s10_report_lines",
    rf"""WITH cells AS (SELECT doc_id, n_chars, {REPORT_CELL.format("text")} AS t FROM documents)
SELECT md5(doc_id || ';' || CASE WHEN regexp_matches(t, '[";\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ';' || n_chars) AS line FROM cells""",
)
def report_lines(spark, folder):
    lines = reports.report_lines(model.table(spark, folder, "documents").select("doc_id", "text", "n_chars"))
    return lines.select(F.md5("line").alias("line"))


@query(
    "s10_written_report",
    """SELECT CAST(l_orderkey AS VARCHAR) || ';' || l_returnflag || ';' || regexp_replace(regexp_replace(replace(printf('%.2f', l_extendedprice), '.', ','), '0$', ''), ',0$', '') AS line
FROM lineitem UNION ALL SELECT 'l_orderkey;l_returnflag;l_extendedprice'""",
)
def written_report(spark, folder):
    path = scratch_folder(spark, "report")
    rows = model.table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    reports.write_report(rows, path, ["l_orderkey"])
    return spark.read.option("lineSep", reports.LINE_END).text(path).select(F.ltrim("value", F.lit("﻿")).alias("line"))


@query(
    "s12_nested_localities",
    f"WITH {model.MUNICIPALITY_SQL} SELECT lpad(CAST(CAST(ibge_code AS INTEGER) AS VARCHAR), 7, '0') AS ibge_code, name, state FROM municipality",
)
def nested_localities(spark, folder):
    """Half of the places carry their state below the older region branch, half below the newer one."""
    rows = model.municipality(spark, folder)
    state = F.struct(F.struct(F.col("state").alias("sigla")).alias("UF"))
    older = F.col("ibge_code").rlike("[0-4]$")
    raw = rows.select(
        F.col("ibge_code").cast("int").alias("id"), F.col("name").alias("nome"),
        F.when(older, F.struct(state["UF"].alias("x"), state.alias("mesorregiao"))).alias("microrregiao"),
        F.when(~older, F.struct(state.alias("regiao-intermediaria"))).alias("regiao-imediata"),
    )
    return geography.catalog_from_regions(raw)


@query(
    "s14_full_scan",
    f"WITH {model.PUBLISHED_SQL} SELECT id, indicator_code, municipality_ibge_code, CAST(reference_period AS VARCHAR) AS reference_period, value FROM published",
)
def full_scan(spark, folder):
    return model.published(spark, folder).select(
        "id", "indicator_code", "municipality_ibge_code", F.col("reference_period").cast("string").alias("reference_period"), "value"
    )


@query(
    "s7_derived_records",
    f"""WITH {model.STAGED_SQL}, sheets AS (SELECT import_id, sheet_name, count(*) AS n, row_number() OVER (PARTITION BY import_id ORDER BY sheet_name) AS p FROM staged GROUP BY 1, 2),
  most AS (SELECT import_id, max(p) AS p FROM sheets GROUP BY 1)
SELECT import_id, s.sheet_name || ' · cópia' AS sheet_name, CAST(m.p + s.p AS INTEGER) AS sheet_position, n AS row_count, 5 AS column_count,
  'data,desconto,municipio,quantidade,valor' AS names, 20 AS sampled, (SELECT min(row_number) FROM staged t WHERE t.import_id = s.import_id AND t.sheet_name = s.sheet_name) AS first_origin
FROM sheets s JOIN most m USING (import_id)""",
)
def derived_records(spark, folder):
    """Records of a copy of every staged sheet."""
    staged = model.staged(spark, folder)
    order = Window.partitionBy("import_id").orderBy("sheet_name")  # the sheets of one import
    records = tables.sheet_records(staged).withColumn("sheet_position", F.row_number().over(order))
    derived = tables.derive_sheet(staged, " · cópia")
    made = tables.derived_records(records, derived)
    origin = derived.filter("row_number = 1").select(*tables.SHEET, F.col("normalized_row")["origin_row_number"].cast("long").alias("first_origin"))
    names = F.array_join(F.array_sort(F.transform("columns_profile", lambda c: c["name"])), ",")
    return made.join(origin, tables.SHEET).select(
        *tables.SHEET, "sheet_position", "row_count", "column_count", names.alias("names"), F.size("sample_rows").alias("sampled"), "first_origin"
    )


@query(
    "s8_import_totals",
    "SELECT 'file ' || l_returnflag AS import_id, 100 + count(*) AS total_rows FROM lineitem GROUP BY 1",
)
def import_totals(spark, folder):
    """Imports that held nothing take in all staged rows."""
    staged = model.staged(spark, folder)
    imports = staged.select("import_id").distinct().withColumn("total_rows", F.lit(100).cast("long"))
    nothing = spark.createDataFrame([], tables.STAGED)
    return tables.import_totals(imports, nothing, tables.include_remaining(nothing, tables.sheet_records(nothing), staged))


# Grids: a sheet per order status and priority, with titles, a two-level header, a repeated header and a note.
SHEET = ["file", "sheet"]


def _grid(spark, folder):
    """The stored grid of all sheets."""
    path = model.stored(spark, folder, "grid", lambda path: _grid_rows(spark, folder).write.parquet(path))
    return spark.read.schema("file string, sheet string, row_number long, cells array<string>").parquet(path)


def _grid_rows(spark, folder):
    orders = model.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("file"), F.col("o_orderpriority").alias("sheet"), "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    numbered = number_rows(orders, SHEET, "o_orderkey", [], "n")
    none = F.lit(None).cast("string")
    code = model.municipality_code(F.col("o_custkey"))
    # Data start in row 5; from the eleventh record on rows move down by one for the repeated header.
    at = F.col("n") + 4 + F.when(F.col("n") > 10, 1).otherwise(0)
    data = numbered.select(
        *SHEET, at.cast("long").alias("row_number"),
        F.array(code, F.concat(F.lit("Place "), "o_custkey"), F.year("o_orderdate").cast("string"), model.br_text(F.col("o_totalprice")), none).alias("cells"),
    )
    sheets = numbered.groupBy(*SHEET).agg(F.max("n").alias("n"))
    header = ["Código", "Município", "Ano", "Valor\nR$", None]
    fixed = [
        (F.lit(1), ["Relatório", None, None, None, None]),
        (F.lit(3), ["Lugar", None, "Medida", None, None]),
        (F.lit(4), header),
        (F.when(F.col("n") >= 10, 15), [h and h.upper() for h in ["Lugar Código", "Lugar Município", "Medida Ano", "Medida Valor R$", None]]),
        (F.col("n") + 20, [None, "Fonte: pedidos", None, None, None]),
    ]
    extra = F.array(*[F.struct(at.cast("long").alias("row_number"), F.array(*[F.lit(c).cast("string") for c in cells]).alias("cells")) for at, cells in fixed])
    more = sheets.select(*SHEET, F.inline(extra)).filter(F.col("row_number").isNotNull())
    index_sheet = sheets.select("file", F.lit("Índice").alias("sheet"), F.lit(1).cast("long").alias("row_number"), F.array(F.lit("a"), F.lit("b")).alias("cells")).distinct()
    return data.unionByName(more).unionByName(index_sheet)


SHEETS_SQL = "sheets AS (SELECT o_orderstatus AS file, o_orderpriority AS sheet, count(*) AS n FROM orders GROUP BY 1, 2)"


@query("t1_sheet_sizes", f"WITH {SHEETS_SQL} SELECT file, sheet, n + 20 AS rows, 4 AS columns FROM sheets")
def sheet_sizes(spark, folder):
    return grid.sheet_sizes(_grid(spark, folder))


def _no_index(spark, folder):
    """The grid without navigation sheets, as the sheet sizes tell them."""
    rows = _grid(spark, folder)
    return rows.join(grid.sheet_sizes(rows).select(*SHEET), SHEET, "left_semi")


@query(
    "t2_t3_headers",
    f"""WITH {SHEETS_SQL} SELECT file, sheet, '3,4' AS header_rows, CAST(5 AS BIGINT) AS first_data,
  'Lugar Código|Lugar Município|Medida Ano|Medida Valor R$' AS names FROM sheets""",
)
def headers(spark, folder):
    rows = grid.infer_headers(_no_index(spark, folder))
    return rows.select(
        *SHEET, F.array_join(F.transform("header_rows", lambda r: r.cast("string")), ",").alias("header_rows"), "first_data", F.array_join("names", "|").alias("names")
    )


def _table_rows(spark, folder):
    rows = _no_index(spark, folder)
    return grid.table_rows(rows, grid.infer_headers(rows))


@query(
    "t4_t5_table_rows",
    """SELECT o_orderstatus AS import_id, o_orderpriority AS sheet_name, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS row_number,
  'Place ' || o_custkey AS place, CAST(year(o_orderdate) AS VARCHAR) AS year, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS value FROM orders""",
)
def table_rows(spark, folder):
    staged = grid.staged_rows(_table_rows(spark, folder))
    cell = lambda name: F.try_element_at("raw_row", F.lit(name))
    return staged.select(
        "import_id", "sheet_name", "row_number", cell("Lugar Município").alias("place"), cell("Medida Ano").alias("year"), cell("Medida Valor R$").alias("value")
    )


@query(
    "t6_largest_sheet",
    f"WITH {SHEETS_SQL} SELECT file, min_by(sheet, (-n, sheet)) AS sheet, max(n) * 4 AS cells FROM sheets GROUP BY 1",
)
def largest_sheet(spark, folder):
    return grid.largest_sheet(_table_rows(spark, folder))


@query("t7_quality_warnings", f"WITH {SHEETS_SQL} SELECT file, sheet, 0 AS sparse_columns, CASE WHEN n <> 100 THEN 100 END AS promised_rows, n AS rows FROM sheets")
def quality_warnings(spark, folder):
    rows = _no_index(spark, folder)
    titled = rows.withColumn("cells", F.when(F.col("row_number") == 1, F.array(F.lit("As 100 maiores_cidades"))).otherwise(F.col("cells")))
    return grid.quality_warnings(titled, _table_rows(spark, folder))


def _late_grid(spark, folder):
    """A sheet per order status whose fourth and fifth column are empty but for one order in 500; the fifth has no title."""
    orders = model.table(spark, folder, "orders").select(F.lit("f").alias("file"), F.col("o_orderstatus").alias("sheet"), "o_orderkey", "o_orderdate", "o_totalprice")
    numbered = number_rows(orders, SHEET, "o_orderkey", [], "n")
    late = F.when(F.col("n") % 500 == 20, F.col("o_orderkey").cast("string"))
    cells = F.array(F.concat(F.lit("Lugar "), "o_orderkey"), F.year("o_orderdate").cast("string"), F.col("o_totalprice").cast("string"), late, late)
    data = numbered.select(*SHEET, (F.col("n") + 1).cast("long").alias("row_number"), cells.alias("cells"))
    title = F.array(F.lit("Lugar"), F.lit("Ano"), F.lit("Valor"), F.lit("Nota"), F.lit(None).cast("string"))
    return data.unionByName(orders.select(*SHEET).distinct().select(*SHEET, F.lit(1).cast("long").alias("row_number"), title.alias("cells")))


LATE_SQL = "numbered AS (SELECT o_orderstatus AS sheet, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders)"


@query(
    "t3_late_columns",
    f"""WITH {LATE_SQL} SELECT sheet, n AS row_number, CASE WHEN n % 500 = 20 THEN CAST(o_orderkey AS VARCHAR) END AS titled,
  CASE WHEN n % 500 = 20 THEN CAST(o_orderkey AS VARCHAR) END AS untitled FROM numbered""",
)
def late_columns(spark, folder):
    """Columns that are empty in the first rows keep all their later values."""
    rows = _late_grid(spark, folder)
    staged = grid.staged_rows(grid.table_rows(rows, grid.infer_headers(rows)))
    cell = lambda name: F.try_element_at("raw_row", F.lit(name))
    return staged.select(F.col("sheet_name").alias("sheet"), "row_number", cell("Nota").alias("titled"), cell("__UNNAMED__4").alias("untitled"))


@query(
    "t7_sparse_columns",
    f"""WITH {LATE_SQL} SELECT 'f' AS file, sheet, CASE WHEN count(*) FILTER (n % 500 = 20) > 0 THEN 1 ELSE 0 END AS sparse_columns,
  CAST(NULL AS INTEGER) AS promised_rows, count(*) AS rows FROM numbered GROUP BY sheet""",
)
def sparse_columns(spark, folder):
    """One untitled column of each sheet has few values."""
    rows = _late_grid(spark, folder)
    return grid.quality_warnings(rows, grid.table_rows(rows, grid.infer_headers(rows)))


# Column profiles: every twelve parts make up the columns of a sheet.
COLUMNS = 12


def _profile(spark, folder):
    size = F.col("p_size")
    names = [
        F.lit("codigo_municipio"), F.lit("nome_municipio"), F.when(size > 25, "ano").otherwise("ano_base"),
        F.when(size > 25, "mes").otherwise("posicao_2020"), F.lit("valor"), F.lit("janeiro_2020_saldos"), F.lit("fevereiro_2020_saldos"),
        F.concat(F.lit("saldos_mar_"), (size + 2000).cast("string")), F.lit("estoque_2019"), F.lit("estoque_2021"),
        F.lit("potencia_outorgada_kw"), F.lit("competencia"),
    ]
    sample = F.array(F.lit("jan/2020"), F.lit("02/2020"), F.lit("2020-03"), F.lit("total"), F.lit("Março 2020"))
    return model.table(spark, folder, "part").select(
        F.lit("f").alias("import_id"), F.floor(F.col("p_partkey") / COLUMNS).cast("string").alias("sheet_name"),
        (F.col("p_partkey") % COLUMNS + 1).cast("int").alias("position"), F.element_at(F.array(*names), (F.col("p_partkey") % COLUMNS + 1).cast("int")).alias("column_name"),
        sample.alias("sample"), "p_size",
    )


PROFILE_SQL = f"""profile AS (
  SELECT CAST(p_partkey // {COLUMNS} AS VARCHAR) AS sheet_name, CAST(p_partkey % {COLUMNS} + 1 AS INTEGER) AS position, (['codigo_municipio', 'nome_municipio',
    CASE WHEN p_size > 25 THEN 'ano' ELSE 'ano_base' END, CASE WHEN p_size > 25 THEN 'mes' ELSE 'posicao_2020' END, 'valor', 'janeiro_2020_saldos',
    'fevereiro_2020_saldos', 'saldos_mar_' || (p_size + 2000), 'estoque_2019', 'estoque_2021', 'potencia_outorgada_kw', 'competencia'])[p_partkey % {COLUMNS} + 1] AS column_name
  FROM part)"""


@query(
    "n1_n2_canonical_names",
    f"""WITH named AS (
  SELECT CAST(p_partkey // {COLUMNS} AS VARCHAR) AS sheet_name, CAST(p_partkey % {COLUMNS} + 1 AS INTEGER) AS position, CASE WHEN p_size = 1 THEN 'coluna_' || (p_partkey % {COLUMNS} + 1)
    ELSE replace(p_name, ' ', '_') || '_cao' END AS base FROM part)
SELECT sheet_name, position, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS canonical_name
FROM (SELECT *, row_number() OVER (PARTITION BY sheet_name, base ORDER BY position) AS n FROM named)""",
)
def canonical_names(spark, folder):
    profile = _profile(spark, folder).drop("column_name")
    part = model.table(spark, folder, "part").select(
        F.floor(F.col("p_partkey") / COLUMNS).cast("string").alias("sheet_name"), (F.col("p_partkey") % COLUMNS + 1).cast("int").alias("position"), "p_name"
    )
    name = F.when(F.col("p_size") == 1, F.lit("__UNNAMED__7")).otherwise(F.concat(F.lit(" "), F.initcap("p_name"), F.lit("/ ÇÃO")))
    named = profile.join(part, ["sheet_name", "position"]).withColumn("column_name", name)
    return profiling.canonical_names(named).select("sheet_name", "position", "canonical_name")


def _matches(pattern: str) -> str:
    return f"regexp_matches(column_name, '{pattern}')"


@query(
    "n4_n8_classify_columns",
    f"""WITH {PROFILE_SQL} SELECT sheet_name, position, column_name = 'codigo_municipio' AS is_code, column_name IN ('codigo_municipio', 'nome_municipio') AS is_municipality,
  {_matches("(janeiro|fevereiro|mar)_20")} AS is_monthly, {_matches("estoque_20")} AS is_annual, column_name = 'codigo_municipio' OR column_name = 'nome_municipio' AS is_identity FROM profile""",
)
def classify_columns(spark, folder):
    return profiling.classify_columns(_profile(spark, folder)).select(
        "sheet_name", "position", "is_code", "is_municipality", "is_monthly", "is_annual", "is_identity"
    )


def _only(column: str) -> str:
    return f"max(CASE WHEN column_name = '{column}' THEN column_name END)"


@query(
    "n6_suggest_mapping",
    f"""WITH {PROFILE_SQL} SELECT sheet_name, {_only("codigo_municipio")} AS municipality_code, {_only("nome_municipio")} AS municipality_name,
  {_only("ano")} AS reference_year, {_only("valor")} AS value FROM profile GROUP BY 1""",
)
def suggest_mapping(spark, folder):
    return profiling.suggest_mapping(_profile(spark, folder)).drop("import_id")


@query(
    "n7_recommend_indicators",
    f"""WITH {PROFILE_SQL}, s AS (
  SELECT sheet_name, {_only("codigo_municipio")} IS NOT NULL AND max(CASE WHEN {_matches("saldos|estoque")} THEN 1 END) = 1 AS employment,
    coalesce({_only("fevereiro_2020_saldos")}, {_only("janeiro_2020_saldos")}) AS saldos, coalesce({_only("estoque_2021")}, {_only("estoque_2019")}) AS estoque,
    {_only("potencia_outorgada_kw")} AS power, max(CASE WHEN {_matches("^saldos_mar")} THEN column_name END) AS mar FROM profile GROUP BY 1)
SELECT sheet_name, 'caged_saldo_empregos' AS code, coalesce(saldos, mar) AS value_field FROM s WHERE employment AND coalesce(saldos, mar) IS NOT NULL
UNION ALL SELECT sheet_name, 'caged_estoque_empregos', estoque FROM s WHERE employment AND estoque IS NOT NULL
UNION ALL SELECT sheet_name, 'potencia_geracao_instalada', power FROM s WHERE NOT coalesce(employment, false) AND power IS NOT NULL""",
)
def recommend_indicators(spark, folder):
    return profiling.recommend_indicators(_profile(spark, folder)).select("sheet_name", "code", "value_field")


@query(
    "n9_suggest_period",
    f"""WITH {PROFILE_SQL}, s AS (
  SELECT sheet_name, coalesce({_only("ano")}, {_only("ano_base")}) AS y, {_only("mes")} AS m, {_only("competencia")} AS d FROM profile GROUP BY 1)
SELECT sheet_name, CASE WHEN y IS NOT NULL AND m IS NOT NULL THEN 'month_year_columns' WHEN y IS NOT NULL THEN 'year_column' WHEN coalesce(d, m) IS NOT NULL THEN 'date_column' ELSE 'fixed' END AS mode,
  CASE WHEN y IS NOT NULL AND m IS NULL OR coalesce(y, d, m) IS NULL THEN 'year' ELSE 'month' END AS granularity,
  y AS year_field, CASE WHEN y IS NOT NULL THEN m END AS month_field, CASE WHEN y IS NULL THEN coalesce(d, m) END AS date_field FROM s""",
)
def suggest_period(spark, folder):
    return profiling.suggest_period(_profile(spark, folder)).drop("import_id")


@query(
    "n8_municipality_choice",
    f"""WITH {PROFILE_SQL}, known AS (SELECT *, column_name IN ('codigo_municipio', 'nome_municipio') AS is_recognised FROM profile)
SELECT sheet_name, column_name, CAST(row_number() OVER (PARTITION BY sheet_name ORDER BY is_recognised DESC, position) AS INTEGER) AS choice, is_recognised,
  coalesce(column_name = max(CASE WHEN is_recognised THEN column_name END) OVER (PARTITION BY sheet_name), false) AS is_suggested FROM known""",
)
def municipality_choice(spark, folder):
    return profiling.municipality_columns(_profile(spark, folder)).drop("import_id")


@query(
    "p5_n10_period_measures",
    f"""WITH {PROFILE_SQL}, parsed AS (
  SELECT sheet_name, position, column_name, regexp_matches(column_name, '(janeiro|fevereiro|mar)_20') AS monthly,
    CASE WHEN contains(column_name, 'saldos') THEN 'saldos' WHEN contains(column_name, 'estoque') THEN 'estoque' ELSE 'posicao' END AS measure,
    CAST(regexp_extract(column_name, '(20[0-9][0-9])', 1) AS INTEGER) AS y,
    CASE WHEN contains(column_name, 'janeiro') THEN 1 WHEN contains(column_name, 'fevereiro') THEN 2 WHEN contains(column_name, '_mar_') THEN 3 END AS m
  FROM profile WHERE regexp_matches(column_name, '20[0-9][0-9]'))
SELECT sheet_name, CASE WHEN monthly THEN 'month' ELSE 'year' END AS granularity, measure, string_agg(column_name, ',' ORDER BY y, m, position) AS fields FROM parsed
GROUP BY ALL HAVING count(*) >= 2""",
)
def period_measures(spark, folder):
    rows = profiling.period_measure_groups(_profile(spark, folder))
    return rows.select("sheet_name", "granularity", "measure", F.array_join("fields", ",").alias("fields"))


@query(
    "n11_expanded_sheets",
    f"""WITH {PROFILE_SQL} SELECT sheet_name, coalesce({_only("competencia")} IS NOT NULL AND {_only("valor")} IS NOT NULL AND {_only("codigo_municipio")} IS NOT NULL, false) AS is_expanded,
  CASE WHEN {_only("competencia")} IS NOT NULL THEN 'month' ELSE 'year' END AS granularity FROM profile GROUP BY 1""",
)
def expanded_sheets(spark, folder):
    renamed = F.when(F.col("column_name") == "valor", "coluna_original").when(F.col("column_name") == "codigo_municipio", "linha_original").otherwise(F.col("column_name"))
    profile = _profile(spark, folder).withColumn("column_name", renamed).withColumn("sample", F.array(F.lit("2020-01-01")))
    return profiling.expanded_sheets(profile).drop("import_id")


@query(
    "n5_profile_table",
    """SELECT 'o_orderkey' AS column_name, 1 AS position, 'bigint' AS dtype, count(*) AS rows, 0 AS null_count FROM orders
UNION ALL SELECT 'price', 2, 'double', count(*), count(*) FILTER (WHERE o_totalprice < 100000) FROM orders
UNION ALL SELECT 'o_orderstatus', 3, 'string', count(*), 0 FROM orders""",
)
def profile_table(spark, folder):
    price = F.when(F.col("o_totalprice") >= 100000, F.col("o_totalprice")).alias("price")
    profile = profiling.profile_dataframe(model.table(spark, folder, "orders").select("o_orderkey", price, "o_orderstatus"))
    return profile.select("column_name", "position", "dtype", "rows", "null_count")


@query(
    "n5_profile_staged",
    f"""WITH {model.STAGED_SQL}, sizes AS (SELECT import_id, sheet_name, count(*) AS rows FROM staged GROUP BY 1, 2)
SELECT import_id, sheet_name, c AS column_name, p AS position, CASE c WHEN 'quantidade' THEN 'bigint' ELSE 'string' END AS dtype, rows, 0 AS null_count, 20 AS sampled
FROM sizes, (VALUES ('municipio', 1), ('data', 2), ('valor', 3), ('quantidade', 4), ('desconto', 5)) AS t(c, p)""",
)
def profile_staged(spark, folder):
    profile = profiling.with_positions(profiling.profile_staged(model.staged(spark, folder)))
    return profile.withColumn("sampled", F.size("sample")).drop("sample")


@query(
    "n3_decimal_columns",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price, CAST(o_custkey AS VARCHAR) AS plain FROM orders""",
)
def decimal_columns(spark, folder):
    price = F.when(F.col("o_orderstatus") == "P", F.lit(" - ")).otherwise(model.br_text(F.col("o_totalprice")))
    cells = model.table(spark, folder, "orders").select("o_orderkey", price.alias("price"), F.col("o_custkey").cast("string").alias("plain"))
    return profiling.normalise_decimals(cells)


@query(
    "n1_column_names",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'acao_de_teste_' || (o_custkey % 7 + 2) ELSE lower(o_orderstatus) || '_preco_medio_' || o_custkey END AS name FROM orders""",
)
def column_names(spark, folder):
    key = F.col("o_custkey")
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("  Ação  de/teste_duplicated_"), (key % 7).cast("string"))).otherwise(
        F.concat("o_orderstatus", F.lit("/Preço \t médio "), key.cast("string"))
    )
    return model.table(spark, folder, "orders").select("o_orderkey", naming.column_name(raw).alias("name"))


def _portal_pages(spark, folder):
    """The given pages as a portal would serve them: in a section of a government host or of another, with links to data around the page.

    Each has the same kinds of links: data and other files, in its own section, in another and on another host, repeated and in comments.
    """
    key = F.col("page_id")
    number = key.cast("string")
    host = F.when(key % 3 == 0, F.lit("https://dados.gov.br")).otherwise(F.lit("https://portal.example.org"))
    page = F.concat(host, F.lit("/pt-br/saude/leitos/"), number, F.lit(".html"))
    hrefs = [F.concat(F.lit("/saude/leitos/a"), number, F.lit(".csv")), F.lit("b.XLSX?x=1&amp;y=2"), F.lit("../leitos/c.zip#f"), F.lit("/saude/obras/d.json"), F.lit("//outro.example.net/e.gz"), F.lit("f.html"), F.lit("ftp://g.org/g.csv"), F.lit("b.XLSX?x=1&amp;y=2")]
    anchors = F.concat(F.lit('<!-- <a href="no.csv">n</a> -->'), *[p for href in hrefs for p in (F.lit('<a class="x" href="'), href, F.lit('">l</a>'))])
    mark = F.when(key % 7 == 1, F.lit("<script src='https://challenges.cloudflare.com/x'></script>")).when(key % 7 == 2, F.lit("<title>Human Verification</title>")).otherwise(F.lit(""))
    return model.table(spark, folder, "pages").select("page_id", page.alias("url"), F.concat("html", anchors, mark).alias("html"))


LINKS_SQL = """page AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://dados.gov.br' ELSE 'https://portal.example.org' END AS host FROM pages),
links AS (
  SELECT page_id, host || '/pt-br/saude/leitos/' || page_id || '.html' AS page_url, unnest([
    {'k': 1, 'name': 'a' || page_id || '.csv', 'link': host || '/saude/leitos/a' || page_id || '.csv'},
    {'k': 2, 'name': 'b.XLSX', 'link': host || '/pt-br/saude/leitos/b.XLSX?x=1&y=2'},
    {'k': 3, 'name': 'c.zip', 'link': host || '/pt-br/saude/leitos/c.zip#f'},
    {'k': CASE WHEN page_id % 3 = 0 THEN NULL ELSE 4 END, 'name': 'd.json', 'link': host || '/saude/obras/d.json'},
    {'k': 5, 'name': 'e.gz', 'link': 'https://outro.example.net/e.gz'}]) AS l FROM page)"""


@query(
    "d1_d2_page_links",
    f"""WITH {LINKS_SQL} SELECT page_id, page_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY l.k) AS INTEGER) AS position, l.name AS name, l.link AS link
FROM links WHERE l.k IS NOT NULL""",
)
def page_links(spark, folder):
    """Data files only; on a government host those of the page's own section."""
    return links.download_links(_portal_pages(spark, folder))


@query(
    "u2_first_source",
    f"""WITH {LINKS_SQL}, c AS (
  SELECT page_id, 'catalog' AS source, 1 AS place, l.link AS link FROM links WHERE l.k IS NOT NULL AND page_id % 5 = 0
  UNION ALL SELECT page_id, 'folder', 2, l.link FROM links WHERE l.k IS NOT NULL AND page_id % 2 = 0
  UNION ALL SELECT page_id, 'page', 3, l.link FROM links WHERE l.k IS NOT NULL)
SELECT page_id, source, link FROM c QUALIFY place = min(place) OVER (PARTITION BY page_id)""",
)
def first_source(spark, folder):
    """Candidates of three sources per page; the first source that has any wins."""
    found = links.download_links(_portal_pages(spark, folder)).select("page_id", "link")
    key = F.col("page_id")
    sources = F.array_compact(
        F.array(
            F.when(key % 5 == 0, F.struct(F.lit("catalog").alias("source"), F.lit(1).alias("place"))),
            F.when(key % 2 == 0, F.struct(F.lit("folder").alias("source"), F.lit(2).alias("place"))),
            F.struct(F.lit("page").alias("source"), F.lit(3).alias("place")),
        )
    )
    candidates = found.select("page_id", "link", F.inline(sources))
    return links.first_source(candidates, ["page_id"], "source", "place").select("page_id", "source", "link")


@query("d3_bot_challenges", "SELECT page_id, page_id % 7 IN (1, 2) AS is_challenge FROM pages")
def bot_challenges(spark, folder):
    return _portal_pages(spark, folder).select("page_id", links.is_bot_challenge(F.col("html")).alias("is_challenge"))


@query(
    "d1_lexed_links",
    """SELECT o_orderkey AS page_id, 'https://h.org/p/d/' || o_orderkey || 'é.csv?x=1&copy=2' AS link FROM orders""",
)
def lexed_links(spark, folder):
    """Pages with links in comments, scripts, text areas and attribute values, and one true link with character references."""
    key = F.col("o_orderkey").cast("string")
    before = F.lit("""<!-- <a href="no.csv"> --><textarea><a href="no.csv"></textarea><img alt='<a href="no.csv">'><a title="x > y" HREF = 'd&#47;""")
    html = F.concat(before, key, F.lit("""&eacute;.csv?x=1&copy=2'>file</a><script>x = '<a href="no.csv">'"""))
    pages = model.table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("https://h.org/p/").alias("url"), html.alias("html"))
    return links.download_links(pages).select("page_id", "link")
