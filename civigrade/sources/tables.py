"""CSV and JSON sources, and the staged rows they become."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civigrade.functions.naming import unique_names
from civigrade.functions.text import put_fields
from civigrade.operators.joins import first_per_key, lookup, number_rows, planned_bytes, prefix_sums
from civigrade.operators.profiling import as_staged_cells, holds_regional_decimals, normalise_columns, normalise_decimals, profile_staged, regional_decimal, with_positions
from civigrade.sources.records import CHUNK, chunk_of, whole_records

SEPARATORS = (";", ",", "\t", "|")
SAMPLE_LINES = 20
SAMPLE_ROWS = 20
ROWS_PER_FILE = 2_000_000
#: Planned size of the staged rows that one task sorts, as the optimiser sees them.
STAGED_TASK_BYTES = 8 << 20
MOST_STAGED_TASKS = 4096
MOST_LAYOUTS = 64
WRAPPED_LINES, FEWEST_WRAPPED_LINES = 7, 4
LATIN = "ISO-8859-1"
ORDER_COLUMNS = ["__file", "__block", "__at"]
SHEET = ["import_id", "sheet_name"]
STAGED = "import_id string, sheet_name string, row_number long, raw_row map<string,string>, normalized_row map<string,string>"
LABEL_MARK = "(Código)"


def _windows_letters() -> tuple[str, str]:
    """Control characters a Latin-1 reader sees where the file has Windows letters, and those letters."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(c for c, letter in pairs if letter), "".join(letter for _, letter in pairs)


_LATIN_CONTROLS, _WINDOWS_LETTERS = _windows_letters()


def _fields(line: Column, separator: str) -> Column:
    """Number of fields of a line; separators inside quotes do not count."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def _separator_count(separator: str):
    return lambda line: _fields(line, separator) - 1


def _unwrapped(line: Column) -> Column:
    return F.replace(F.substring(line, F.lit(2), F.length(line) - 2), F.lit('""'), F.lit('"'))


def _is_wrapped(separator: str, width: Column):
    """Whether a line is one quoted field that holds a whole record."""
    return lambda line: line.rlike('^"([^"]|"")*"$') & (_fields(_unwrapped(line), separator) == width)


def dialects(spark: SparkSession, path: str, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """Encoding, separator, wrapping, header and multi-line cells of every CSV file below ``path`` (gzip too).

    Encoding and multi-line cells are judged on all lines, separator and wrapping on the first ``sample_lines`` of each file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    text = F.regexp_replace(F.make_valid_utf8("value"), "^﻿|\r$", "")
    # A quoted cell with a line break leaves an odd number of quotes on its first line.
    is_open = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
    whole = lines.groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), F.lit("UTF-8")).otherwise(F.lit(LATIN)).alias("encoding"), F.bool_or(is_open).alias("has_breaks")
    )
    first = first_per_key(lines.filter(F.col("block") == 0), ["file"], F.col("at"), rows=sample_lines)
    heads = first.groupBy("file").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", text.alias("line")))), lambda s: s["line"]).alias("lines"),
        F.min_by(F.col("value").cast("binary"), "at").alias("raw_header"),
    )
    filled = F.filter("lines", lambda line: line != "")
    scores = []
    for separator in SEPARATORS:
        counts = F.transform(filled, _separator_count(separator))
        steady = (F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts))
        total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
        scores.append(F.struct(steady.cast("int").alias("steady"), total.alias("total"), F.lit(separator).alias("separator")))
    best = F.array_max(F.array(*scores))
    chosen = heads.withColumn("separator", F.when(best["total"] > 0, best["separator"]).otherwise(F.lit(",")))
    # Wrapped records hide their separators in quotes, so the header alone tells the separator then.
    header = F.col("lines")[0]
    records = F.slice("lines", 2, WRAPPED_LINES - 1)
    wrapped = F.lit(None).cast("string")
    for separator in reversed(SEPARATORS):
        width = _fields(header, separator)
        fits = (width >= 2) & (F.size("lines") >= FEWEST_WRAPPED_LINES) & F.forall(records, _is_wrapped(separator, width))
        wrapped = F.when(fits, F.lit(separator)).otherwise(wrapped)
    return (
        chosen.withColumn("wrapped", wrapped)
        .join(whole, "file")
        .select(
            "file", "encoding", F.coalesce("wrapped", "separator").alias("separator"),
            F.col("wrapped").isNotNull().alias("is_wrapped"), "has_breaks",
            F.when(F.col("encoding") == LATIN, F.regexp_replace(F.decode("raw_header", LATIN), "\r$", "")).otherwise(header).alias("header"),
        )
    )


def read_csv(spark: SparkSession, path: str, most_layouts: int = MOST_LAYOUTS, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """All cells of a folder of CSV files as text, each file read with the dialect and the header found in it.

    Files are read together by layout and meet by column name; a column that a layout lacks is null in its rows. Adds the hidden
    order columns :func:`stage` numbers rows by. Files with line breaks inside cells are read by all tasks too, block by block
    (:mod:`civigrade.sources.records`). The layouts, not the files, are what the driver loops over; more than ``most_layouts`` are
    refused.
    """
    layout = ["encoding", "separator", "is_wrapped", "has_breaks", "header"]
    found = dialects(spark, path, sample_lines).groupBy(*layout).agg(F.sort_array(F.collect_list("file")).alias("files"))
    layouts = sorted(found.limit(most_layouts + 1).collect(), key=lambda row: row["files"][0])
    if not layouts:
        raise ValueError(f"no lines in {path}")
    if len(layouts) > most_layouts:
        raise ValueError(f"the files in {path} have more than {most_layouts} layouts")
    parts = [_read_layout(spark, path if len(layouts) == 1 else row["files"], row) for row in layouts]
    order = [*dict.fromkeys(c for part in parts for c in part.columns if c not in ORDER_COLUMNS), *ORDER_COLUMNS]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    return together.select(*[F.col(f"`{c}`") for c in order])


def header_names(header: str, separator: str) -> list[str]:
    """Names of a header as given; a repeated one is marked with its number, an empty one with its position.

    Spark tells columns apart without case, so ``valor`` and ``Valor`` count as repeated. Canonical names come from these marks.
    """
    seen: dict[str, int] = {}
    names = []
    for position, name in enumerate(next(csv.reader([header], delimiter=separator, strict=False)), start=1):
        name = name.strip() or f"__unnamed__{position}"
        count = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        names.append(name if count == 1 else f"{name}_duplicated_{count - 2}")
    return names


def _read_layout(spark: SparkSession, paths: str | list[str], layout) -> DataFrame:
    if layout["is_wrapped"]:
        return _read_wrapped(spark, paths, layout)
    if layout["has_breaks"]:
        return _read_broken(spark, paths, layout)
    reader = spark.read.schema(_ddl(header_names(layout["header"], layout["separator"]))).options(
        header=True, sep=layout["separator"], encoding=layout["encoding"], quote='"', escape='"', mode="PERMISSIVE",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    rows = _with_order(reader.csv(paths))
    return _windows_text(rows) if layout["encoding"] == LATIN else rows


def _read_broken(spark: SparkSession, paths: str | list[str], layout) -> DataFrame:
    """Files with line breaks inside cells: records are cut in every file block, then parsed. The first record of a file is its header."""
    separator, latin = layout["separator"], layout["encoding"] == LATIN
    lines = _with_order(spark.read.option("lineSep", "\n").text(paths))
    text = F.decode(F.col("value").cast("binary"), LATIN) if latin else F.col("value")
    records = whole_records(lines.select(*ORDER_COLUMNS, F.regexp_replace(text, "^\ufeff", "").alias("line")), separator)
    # Cell by cell a carriage return belongs to the text, at the end of a record to the line end.
    records = records.withColumn("record", F.regexp_replace("record", "\r\\z", ""))
    is_header = (F.col("__block") == 0) & (F.col("number") == 1)
    header = layout["header"]
    if header.count('"') % 2:
        header = records.filter(is_header).agg(F.min("record")).first()[0]
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    cells = F.from_csv("record", _ddl(header_names(header, separator)), options)
    parsed = records.filter(~is_header & (F.col("record") != "")).withColumn("cells", cells).select("cells.*", *ORDER_COLUMNS)
    return _windows_text(parsed) if latin else parsed


def _read_wrapped(spark: SparkSession, paths: str | list[str], layout) -> DataFrame:
    """Records written as one quoted field: unwrap the line, then parse it. Only the first line of each file is its header."""
    # A separator that no line has makes the reader split lines only, and take the header off each file.
    reader = spark.read.schema("value string").options(header=True, sep="\u0001", quote="", encoding=layout["encoding"])
    lines = _with_order(reader.csv(paths))
    line = F.regexp_replace("value", "\r$", "")
    is_wrapped = F.startswith(line, F.lit('"')) & F.endswith(line, F.lit('"')) & (F.length(line) >= 2)
    inner = F.when(is_wrapped, _unwrapped(line)).otherwise(line)
    separator = layout["separator"]
    record = F.from_csv(inner, _ddl(header_names(layout["header"], separator)), {"sep": separator, "quote": '"', "escape": '"'})
    parsed = lines.filter(line != "").withColumn("record", record).select("record.*", *ORDER_COLUMNS)
    return _windows_text(parsed) if layout["encoding"] == LATIN else parsed


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def _with_order(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
    )


def _windows_text(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ORDER_COLUMNS]
    fixed = [
        F.translate(F.col(f"`{c}`"), _LATIN_CONTROLS, _WINDOWS_LETTERS).alias(c.translate(str.maketrans(_LATIN_CONTROLS, _WINDOWS_LETTERS)))
        if c in names
        else F.col(f"`{c}`")
        for c in df.columns
    ]
    return df.select(*fixed)


#: Type -> what every filled cell must look like. Whole numbers beyond 18 digits stay exact, and so they never become doubles.
KINDS = (
    ("bigint", "^-?[0-9]{1,18}$"),
    ("decimal(38,0)", "^-?[0-9]{1,38}$"),
    ("double", r"^(?!-?[0-9]{16,}$)-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"),
    ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp_ntz", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"),
    ("boolean", "^(true|false)$"),
)


def infer_types(df: DataFrame) -> DataFrame:
    """Typed columns from text ones: whole numbers, decimals (regional ones too), ISO dates and times, true and false.

    One aggregation over all cells finds types and regional decimals together.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ORDER_COLUMNS]
    if not names:
        return df
    checks = []
    for position, name in enumerate(names):
        cell = F.when(F.col(f"`{name}`") != "", F.col(f"`{name}`"))
        kind = F.lit("string")
        for type_name, pattern in reversed(KINDS):
            fits = F.coalesce(F.bool_and(cell.rlike(pattern) & cell.try_cast(type_name).isNotNull()), F.lit(False))
            kind = F.when(fits, F.lit(type_name)).otherwise(kind)
        checks += [kind.alias(f"kind_{position}"), holds_regional_decimals(F.col(f"`{name}`")).alias(f"regional_{position}")]
    found = df.agg(*checks).first()
    typed = {}
    for position, name in enumerate(names):
        if found[f"kind_{position}"] != "string":
            typed[name] = F.col(f"`{name}`").try_cast(found[f"kind_{position}"])
        elif found[f"regional_{position}"]:
            typed[name] = regional_decimal(F.col(f"`{name}`"))
    return df.withColumns(typed) if typed else df


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV to a typed table: dialect, types, regional decimals, canonical column names (code columns stay text)."""
    return normalise_columns(infer_types(read_csv(spark, path)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of objects. A first record of a file that only holds labels names the columns and is dropped.

    Records further down are data, whatever they look like. Files whose labels differ are refused. Columns that come from folder names
    (``part=1``) are no part of the records: they are neither compared nor renamed.
    """
    rows = spark.read.option("multiLine", True).json(path)
    if "V" not in rows.columns:
        return rows
    # With a given schema nothing is read; what is added to it comes from folder names.
    of_folders = spark.read.schema("V string").json(path).columns[1:]
    own = [c for c in rows.columns if c not in of_folders]
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name in own]
    has_mark = F.lit(False)
    for name in texts:
        has_mark = has_mark | F.coalesce(F.endswith(F.col(f"`{name}`"), F.lit(LABEL_MARK)), F.lit(False))
    record = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    label_of = F.struct(*[F.col(f"record.`{c}`") for c in own])
    # A file of one array is read by one task, in order.
    placed = rows.select(record.alias("record"), (has_mark & F.col("V").isNotNull()).alias("is_label"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = placed.groupBy("file").agg(F.min("at").alias("at"), F.min_by("is_label", "at").alias("is_label"), F.min_by("record", "at").alias("record"))
    labels = first.filter("is_label")
    found = labels.groupBy(F.to_json(label_of)).agg(F.first("record").alias("record")).limit(2).collect()
    if not found:
        return rows
    if len(found) > 1:
        raise ValueError(f"the files in {path} differ in their label records")
    label = found[0]["record"].asDict()
    wanted = [str(label[c]) if c in own and label[c] is not None else c for c in rows.columns]
    # ``at`` names one row, so the join has no hot key.
    data = placed.join(labels.select("at"), "at", "left_anti").select("record.*")
    return data.toDF(*unique_names(spark, wanted, "Coluna ", " (", ")"))


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    return normalise_columns(normalise_decimals(read_json(spark, path)))


def stage(df: DataFrame, import_id: str, sheet_name: str) -> DataFrame:
    """Staged rows of a table read by this module: rows numbered in file order, cells as text by column name.

    Rows are numbered inside chunks of their file block; the rows of earlier chunks are added from a table of counts, which is itself
    summed file by file.
    """
    data = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ORDER_COLUMNS])
    rows = df.select(*ORDER_COLUMNS, chunk_of("__at"), as_staged_cells(data).alias("raw_row"))
    chunks = df.groupBy("__file", "__block", chunk_of("__at")).agg(F.count(F.lit(1)).alias("_rows"))
    files = chunks.groupBy("__file").agg(F.sum("_rows").alias("_file_rows"))
    files = prefix_sums(files, [], F.col("__file"), "_file_rows", "_file_before").drop("_file_rows")
    chunks = prefix_sums(chunks, ["__file"], F.struct("__block", "__chunk"), "_rows", "_before").drop("_rows").join(files, "__file")
    inside = F.row_number().over(Window.partitionBy(*CHUNK).orderBy("__at"))
    numbered = rows.withColumn("_inside", inside).join(chunks, CHUNK)
    return numbered.select(
        F.lit(import_id).alias("import_id"), F.lit(sheet_name).alias("sheet_name"),
        (F.col("_file_before") + F.col("_before") + F.col("_inside")).cast("long").alias("row_number"), "raw_row",
        F.lit(None).cast("map<string,string>").alias("normalized_row"),
    )


def derive_sheet(kept: DataFrame, suffix: str) -> DataFrame:
    """Rows of a derived sheet: renumbered, with the sheet and row they came from."""
    numbered = number_rows(
        kept.withColumnRenamed("row_number", "_origin"), SHEET, "_origin", [], "row_number"
    )
    origin = {"origin_sheet": F.col("sheet_name"), "origin_row_number": F.col("_origin")}
    return numbered.withColumn("normalized_row", put_fields(F.col("normalized_row"), origin)).select(
        "import_id", F.concat("sheet_name", F.lit(suffix)).alias("sheet_name"), "row_number", "raw_row", "normalized_row"
    )


def replace_sheets(staged: DataFrame, derived: DataFrame) -> DataFrame:
    """Staged rows with the sheets of ``derived`` put in place of those of the same name."""
    sheets = derived.select(*SHEET).distinct()
    return staged.join(sheets, SHEET, "left_anti").unionByName(derived.select(*staged.columns))


def write_staged(staged: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write staged rows by import and sheet; sheets that are written replace themselves only.

    Rows are first brought together by import, sheet and range of row numbers, so a sheet gets few files and a large one many tasks.
    There are so many tasks that each sorts its rows by sheet in memory; only a small table is left to the session's number.
    """
    keys = [*SHEET, F.floor(F.col("row_number") / rows_per_file)]
    parts = planned_bytes(staged) // STAGED_TASK_BYTES
    usual = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = staged.repartition(min(parts, MOST_STAGED_TASKS), *keys) if parts > usual else staged.repartition(*keys)
    together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SHEET).parquet(path)


def sheet_records(staged: DataFrame) -> DataFrame:
    """Height and width per staged sheet."""
    widths = staged.select(*SHEET, F.explode(F.map_keys("raw_row")).alias("c")).groupBy(*SHEET, "c").agg(F.count(F.lit(1)).alias("n"))
    columns = widths.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("column_count"))
    heights = staged.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("row_count"))
    return heights.join(columns, SHEET, "left")


def derived_records(records: DataFrame, derived: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Records of derived sheets: position, height, width, profile of every column and the first rows.

    ``records`` (import_id, sheet_name, sheet_position) are the sheets that exist. A sheet that is derived again keeps its position, new
    ones follow the last one of their import by name.
    """
    profile = with_positions(profile_staged(derived))
    entry = F.struct("position", F.col("column_name").alias("name"), "dtype", "null_count")
    columns = profile.groupBy(*SHEET).agg(F.sort_array(F.collect_list(entry)).alias("columns_profile"))
    first = first_per_key(derived.select(*SHEET, "row_number", "raw_row"), SHEET, F.col("row_number"), rows=sample_rows)
    samples = first.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("row_number", F.to_json("raw_row").alias("row")))).alias("s"))
    heights = derived.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("row_count"))
    last = records.groupBy("import_id").agg(F.max("sheet_position").alias("_last"))
    made = heights.join(columns, SHEET, "left").join(samples, SHEET, "left").join(records.select(*SHEET, "sheet_position"), SHEET, "left").join(last, "import_id", "left")
    is_new = F.col("sheet_position").isNull().cast("int")
    order = Window.partitionBy("import_id").orderBy("sheet_name").rowsBetween(Window.unboundedPreceding, 0)  # the sheets of one import
    position = F.coalesce("sheet_position", (F.coalesce("_last", F.lit(0)) + F.sum(is_new).over(order)).cast("int"))
    return made.select(
        *SHEET, position.alias("sheet_position"), "row_count", F.size("columns_profile").alias("column_count"), "columns_profile",
        F.transform("s", lambda x: x["row"]).alias("sample_rows"),
    )


def import_totals(imports: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Imports with ``total_rows`` raised by the staged rows that were added."""
    old = before.groupBy("import_id").agg(F.count(F.lit(1)).alias("_old"))
    new = after.groupBy("import_id").agg(F.count(F.lit(1)).alias("_new"))
    counted = imports.join(old, "import_id", "left").join(new, "import_id", "left")
    added = F.coalesce("_new", F.lit(0)) - F.coalesce("_old", F.lit(0))
    return counted.withColumn("total_rows", F.coalesce("total_rows", F.lit(0)) + F.greatest(added, F.lit(0))).select(*imports.columns)


def include_remaining(staged: DataFrame, sheets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Staged rows plus those of sheets that hold no rows yet; rows already there stay."""
    filled = sheets.filter(F.col("row_count") > 0).select(*SHEET).distinct()
    pending = incoming.join(lookup(filled), SHEET, "left_anti")
    new = pending.join(staged.select(*SHEET, "row_number"), [*SHEET, "row_number"], "left_anti")
    return staged.unionByName(new.select(*staged.columns))
