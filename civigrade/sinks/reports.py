"""CSV reports and the export of staged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civigrade.functions.scoring import maturity
from civigrade.functions.text import number_cell_text
from civigrade.operators.index import compare

BYTE_ORDER_MARK = "﻿"
LINE_END = "\r\n"
MOST_COLUMNS = 10_000


def report_cell(cell: Column, data_type: T.DataType) -> Column:
    """Cell of a report: decimal comma, empty for missing, text that looks like a formula is quoted away."""
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType, T.IntegralType)):
        text = F.coalesce(cell.cast("string"), F.lit("")) if isinstance(data_type, T.IntegralType) else number_cell_text(cell.cast("double"))
        return F.replace(text, F.lit("."), F.lit(","))
    text = cell.cast("string")
    return _quoted(F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text))


def _quoted(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[";\r\n]'), quoted).otherwise(text), F.lit(""))


def report_lines(df: DataFrame) -> DataFrame:
    """One text column ``line`` per row, cells separated by ``;``."""
    cells = [report_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(F.concat_ws(";", *cells).alias("line"))


def header_line(names: list[str], guard: bool = True) -> str:
    def cell(text: str) -> str:
        safe = f"'{text}" if guard and text[:1] in ("=", "+", "-", "@", "\t", "\r") else text
        return '"' + safe.replace('"', '""') + '"' if any(c in safe for c in '";\r\n') else safe

    return ";".join(cell(name) for name in names)


def write_report(df: DataFrame, path: str, order: list[str], header: list[str] | None = None) -> None:
    """Write a report, titled ``header`` or its column names, sorted by ``order``."""
    cells = [report_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    lines = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.concat_ws(";", *cells).alias("line"))
    _write_lines(lines, path, header_line(header or df.columns))


def _write_lines(lines: DataFrame, path: str, header: str) -> None:
    """Write ``line`` as ``part-*`` files that read one after the other are one file: mark, header, sorted rows.

    The rows are range-partitioned by the other columns, so sorting and writing are spread over all tasks.
    """
    order = [c for c in lines.columns if c != "line"]
    first = lines.sparkSession.range(1).select(F.lit(0).alias("_part"), F.lit(BYTE_ORDER_MARK + header).alias("line"))
    both = first.unionByName(lines.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    both.orderBy("_part", *order).select("line").write.option("lineSep", LINE_END).text(path)


def ranking_report(ranked: DataFrame, dimensions: list[tuple[str, str]], selected: str | None = None) -> DataFrame:
    """Columns of the ranking report; ``dimensions`` are (code, name) in order.

    ``selected`` is the name of the dimension the ranking was made by; its score gets its own column, which may have the name of the
    one it repeats.
    """
    score = lambda code: F.try_element_at("dimension_scores", F.lit(code))
    return ranked.select(
        F.col("rank").alias("Posição"), F.col("municipality_ibge_code").alias("Código IBGE"), F.col("name").alias("Município"),
        F.col("state").alias("UF"), *([F.col("score").alias(f"Nota {selected}")] if selected else []), F.col("overall_score").alias("Nota geral"),
        maturity(F.col("overall_score")).alias("Nível de maturidade"),
        *[score(code).alias(f"Nota {name}") for code, name in dimensions],
        F.col("scored_indicators").alias("Indicadores com nota"), F.col("observed_indicators").alias("Indicadores com valor"),
    )


def comparison_report(
    detail: DataFrame, by_dimension: DataFrame, overall: DataFrame, dimensions: DataFrame, codes: list[str], labels: dict[str, str]
) -> DataFrame:
    """Rows of the comparison report: overall score, then per dimension, in display order, its score and its indicators.

    ``dimensions`` has dimension_code, dimension_name and display_order; indicators follow their ``display_order`` where ``detail`` has
    one, else their name. ``labels`` names the compared municipalities. The columns ``_1, _2, _3, _4`` order the rows.
    """
    wanted = list(dict.fromkeys(codes))
    chosen = compare(detail, wanted)
    ours = F.col("municipality_ibge_code").isin(*wanted)
    blank, no_value, no_text, first = F.lit(""), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(0)

    def side_by_side(value: Column, period: Column, score: Column) -> list[Column]:
        columns = []
        for code in wanted:
            own = lambda column, code=code: F.max(F.when(F.col("municipality_ibge_code") == code, column))
            label = labels.get(code, code)
            columns += [own(value).alias(f"Valor {label}"), own(period).alias(f"Período {label}"), own(score).alias(f"Nota {label}")]
        return columns

    def lines(rows: DataFrame, order: list[Column], titles: list[Column]) -> DataFrame:
        names = ["_1", "_2", "_3", "_4", "Dimensão", "Indicador", "Unidade"]
        added = [c for c in rows.columns if c.startswith(("Valor ", "Período ", "Nota "))]
        return rows.select(*[c.alias(n) for c, n in zip(order + titles, names)], *[F.col(f"`{c}`") for c in added])

    total = overall.filter(ours).agg(*side_by_side(no_value, no_text, F.col("overall_score")))
    total = lines(total, [first, first, first, blank], [F.lit("Nota geral"), blank, blank])
    named = dimensions.select("dimension_code", "dimension_name", F.col("display_order").alias("_place"))
    scores = by_dimension.filter(ours).groupBy("dimension_code").agg(*side_by_side(no_value, no_text, F.col("dimension_score")))
    place = F.col("_place").cast("int")
    scores = lines(scores.join(named, "dimension_code"), [F.lit(1), place, first, blank], [F.col("dimension_name"), F.lit("Nota da dimensão"), blank])
    order = F.col("display_order") if "display_order" in detail.columns else F.lit(0)
    keys = ["dimension_code", "indicator_code", "indicator_name", "unit"]
    values = side_by_side(F.col("value").cast("double"), F.col("reference_period").cast("string"), F.col("score"))
    rows = chosen.withColumn("_order", order.cast("int")).groupBy(*keys, "_order").agg(*values)
    rows = lines(rows.join(named, "dimension_code"), [F.lit(1), place, F.col("_order") + 1, F.col("indicator_name")], [F.col("dimension_name"), F.col("indicator_name"), F.col("unit")])
    return total.unionByName(scores).unionByName(rows)


def series_report(points: DataFrame) -> DataFrame:
    """Columns of the series report, one row per point; ``import_title`` names the import."""
    return points.select(
        F.col("municipality_ibge_code").alias("Código IBGE"), F.col("name").alias("Município"), F.col("state").alias("UF"),
        F.col("indicator_name").alias("Indicador"), F.col("reference_period").cast("string").alias("Período"),
        F.col("value").cast("double").alias("Valor"), F.col("unit").alias("Unidade"), F.col("source_name").alias("Fonte"),
        F.col("import_title").alias("Importação"),
    )


def export_columns(staged: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """Columns of all sheets in the order they are first seen. Names only, found by partial aggregates; more than ``most`` are refused."""
    keys = staged.select("sheet_name", "row_number", F.posexplode(F.map_keys("raw_row")).alias("at", "name"))
    first = keys.groupBy("name").agg(F.min(F.struct("sheet_name", "row_number", "at")).alias("place"))
    names = [row["name"] for row in first.orderBy("place").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns; export the sheets one by one")
    return names


def sheet_column(names: list[str]) -> str:
    """Name of the sheet column: ``aba``, or the first free ``aba_n``."""
    name, count = "aba", 2
    while name in names:
        name, count = f"aba_{count}", count + 1
    return name


def export_rows(staged: DataFrame) -> DataFrame:
    """Rows of all sheets side by side, sheet first; ordered by sheet and row when written."""
    names = export_columns(staged)
    return staged.select(
        F.col("sheet_name").alias(sheet_column(names)), *[F.try_element_at("raw_row", F.lit(n)).alias(n) for n in names]
    )


def write_export(staged: DataFrame, path: str) -> None:
    """Write the export of an import as CSV with ``;``, ordered by sheet and row."""
    names = export_columns(staged)
    cells = [_quoted(F.col("sheet_name"))] + [_quoted(F.try_element_at("raw_row", F.lit(n))) for n in names]
    lines = staged.select("sheet_name", "row_number", F.concat_ws(";", *cells).alias("line"))
    _write_lines(lines, path, header_line([sheet_column(names), *names], guard=False))
