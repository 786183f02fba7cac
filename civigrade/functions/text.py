"""Text expressions: folding accents, cell text, search keys, place names, JSON cells."""

from __future__ import annotations

import unicodedata
from typing import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　"

# The 27 federative units a place name may carry.
STATES = (
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA",
    "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
)

# Dimension name -> prefix of its indicator codes.
DIMENSION_PREFIXES = {
    "economia": "eco",
    "pessoas": "pes",
    "governanca": "gov",
    "mobilidade": "mob",
    "ambiente": "amb",
    "qualidade de vida": "qvi",
    "infraestrutura digital e dados": "idd",
}


def _folding_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one ASCII character plus marks, and that character."""
    source, target = [], []
    for code_point in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        letter = chr(code_point)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if base != letter and len(base) == 1 and base.isascii():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _folding_table()
_MARKS = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unaccent(text: Column) -> Column:
    """Fold accented Latin letters to ASCII and drop combining marks."""
    return F.translate(text, _FOLD_FROM + _MARKS, _FOLD_TO)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def cell_text(cell: Column) -> Column:
    """Trimmed text of a cell, ``''`` for a missing one."""
    return F.coalesce(strip(cell.cast("string")), F.lit(""))


def number_cell_text(cell: Column) -> Column:
    """Cell text of a floating point cell: no exponent, whole numbers without fraction, ``''`` if not finite."""
    size = F.abs(cell)
    finite = ~F.isnan(cell) & (size != F.lit(float("inf")))
    whole = (cell == F.floor(cell)) & (size < F.lit(1e15))
    # Between these bounds Spark writes doubles plainly, as short as they can be read back.
    plain = size.between(1e-3, 9_999_999.0)
    long = F.regexp_replace(cell.try_cast("decimal(38,15)").cast("string"), "0+$", "")
    text = F.when(whole, cell.try_cast("bigint").cast("string")).when(plain, cell.cast("string")).otherwise(F.coalesce(long, cell.cast("string")))
    return F.coalesce(F.when(finite, text), F.lit(""))


def search_key(text: Column) -> Column:
    """Accent- and case-insensitive key."""
    return F.replace(F.lower(unaccent(text)), F.lit("ß"), F.lit("ss"))


def title_key(text: Column) -> Column:
    """Trimmed, lower-cased, unaccented title."""
    return strip(F.lower(unaccent(text)))


def column_name(name: Column) -> Column:
    """Canonical name: lower case, no accents, ``_duplicated_k`` counted on, blanks and slashes to one underscore."""
    plain = unaccent(F.lower(strip(name)))
    copy = F.regexp_extract(plain, r"_duplicated_([0-9]+)$", 1)
    counted = F.when(
        copy != "",
        F.concat(F.regexp_replace(plain, r"_duplicated_[0-9]+$", "_"), (copy.try_cast("int") + 2).cast("string")),
    ).otherwise(plain)
    return F.regexp_replace(strip(F.translate(counted, "/", " ")), r"[\s ]+", "_")


def column_title(title: Column) -> Column:
    """A column title as rules on titles read it: canonical and without accents."""
    return title_key(column_name(title))


def evaluated(spark: SparkSession, expression: Column):
    """The value of an expression without input columns, worked out by the optimiser: no job is run."""
    return spark.sql("SELECT * FROM VALUES (1) AS one(x)").select(expression).first()[0]


def words_key(text: Column) -> Column:
    """Search key with every run of other characters turned into one blank."""
    return F.trim(F.regexp_replace(search_key(text), "[^a-z0-9]+", " "))


place_name_key = words_key


# Where a place name holds its state.
BRACKETED_STATE = r"[\s ]*\(([A-Za-z]{2})\)$"
LEADING_STATE = r"^([A-Za-z]{2})[\s ]*-[\s ]*"
TRAILING_STATE = r"[\s ]*[-/][\s ]*([A-Za-z]{2})$"


def parse_place_name(text: Column) -> Column:
    """``name`` and ``state`` of ``Name (UF)``, ``UF-Name``, ``Name - UF`` or ``Name/UF``; null otherwise.

    The first form whose state is one of the 27 wins: the state in brackets at the end, before a hyphen, or after the last hyphen or
    slash.
    """
    whole = strip(text)
    in_brackets, ahead = F.regexp_extract(whole, BRACKETED_STATE, 1), F.regexp_extract(whole, LEADING_STATE, 1)
    behind = F.regexp_extract(whole, TRAILING_STATE, 1)

    def place(state: Column, name: Column) -> Column:
        return F.when(F.upper(state).isin(*STATES) & (name != ""), F.struct(name.alias("name"), F.upper(state).alias("state")))

    return F.coalesce(
        place(in_brackets, strip(F.regexp_replace(whole, BRACKETED_STATE, ""))),
        place(ahead, strip(F.regexp_replace(whole, LEADING_STATE, ""))),
        place(behind, strip(F.regexp_replace(whole, TRAILING_STATE, ""))),
    )


def short_code(code: Column) -> Column:
    """Matrix code (``eco01`` of ``eco01_name``) or else the whole code, upper case."""
    prefix = F.regexp_extract(code, r"(?i)^([a-z]{3}[0-9]{2})_", 1)
    return F.upper(F.when(prefix != "", prefix).otherwise(code))


def dimension_prefix(dimension: Column) -> Column:
    """Three-letter prefix of a dimension given by prefix or by name; null when unknown."""
    key = title_key(dimension)
    result = F.when(key.rlike("^[a-z]{3}$"), key)
    for name, prefix in DIMENSION_PREFIXES.items():
        result = result.when(key == name, F.lit(prefix))
    return result


def merged_row(raw: Column, normalized: Column) -> Column:
    """Raw cells overlaid with the prepared ones (the prepared side wins)."""
    prepared = F.coalesce(normalized, F.expr("map()").cast("map<string,string>"))
    untouched = F.map_filter(raw, lambda key, _: ~F.map_contains_key(prepared, key))
    return F.coalesce(F.map_concat(untouched, prepared), prepared)


def merged_field(raw: Column, normalized: Column, name: str) -> Column:
    """One field of :func:`merged_row` without building the merged map."""
    key = F.lit(name)
    prepared = F.coalesce(F.map_contains_key(normalized, key), F.lit(False))
    return F.when(prepared, F.try_element_at(normalized, key)).otherwise(F.try_element_at(raw, key))


def put_fields(row: Column, fields: dict[str, Column], drop_nulls: bool = False) -> Column:
    """Set ``fields`` in a string map; with ``drop_nulls`` fields without value are removed instead."""
    names = list(fields)
    kept = F.map_filter(F.coalesce(row, F.expr("map()").cast("map<string,string>")), lambda key, _: ~key.isin(*names))
    added = F.create_map(*[part for name in names for part in (F.lit(name), fields[name].cast("string"))])
    if drop_nulls:
        added = F.map_filter(added, lambda _, value: value.isNotNull())
    return F.map_concat(kept, added)


def drop_fields(row: Column, names: list[str]) -> Column:
    return F.map_filter(row, lambda key, _: ~key.isin(*names))


def json_cell(cell: Column, data_type: T.DataType) -> Column:
    """Text a staged cell keeps: ISO dates, plain decimals, nested values as compact JSON, no NaN or infinity."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.nullif(number_cell_text(cell.cast("double")), F.lit(""))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(cell, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(cell, "SSSSSS")
        return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(_finite(cell, data_type))
    return cell.cast("string")


def _finite(cell: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(cell) & (F.abs(cell) != F.lit(float("inf"))), cell)
    if isinstance(data_type, T.StructType):
        return F.when(cell.isNotNull(), F.struct(*[_finite(cell[f.name], f.dataType).alias(f.name) for f in data_type.fields]))
    if isinstance(data_type, T.ArrayType):
        return F.transform(cell, lambda item: _finite(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(cell, lambda _, item: _finite(item, data_type.valueType))
    if isinstance(data_type, T.DecimalType):
        return cell.cast("string")
    return cell
