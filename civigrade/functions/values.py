"""Number expressions: regional formats, ratios, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civigrade.functions.text import cell_text, once, strip

STORED = "decimal(38,10)"
#: Places a number with an exponent may be shifted by; no finite double needs more.
LONGEST_SHIFT = 400

# The accepted spellings of numbers.
BR_GROUPED = r"-?[0-9]{1,3}([.][0-9]{3})+(,[0-9]+)?"
BR_DECIMAL = r"-?[0-9]+,[0-9]+"
US_GROUPED = r"-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?"
PLAIN = r"-?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?"
SIMPLE = r"-?[0-9]+([.][0-9]+)?"
COLUMN_NUMBER = r"^-?(([0-9]{1,3}([.][0-9]{3})*|[0-9]+)(,[0-9]+)?|[0-9]+[.][0-9]+|,[0-9]+)$"
GRID_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _whole(*patterns: str) -> str:
    return "^(" + "|".join(patterns) + ")$"


def _no_dots(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit(""))


def _no_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def _comma_to_dot(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("."))


def exact_text(digits: Column) -> Column:
    """Canonical text of a number written plainly or with an exponent: every digit, no exponent, no idle zeros.

    Nothing is rounded and no number is too long; an exponent beyond ``LONGEST_SHIFT`` places is no number.
    """
    pattern = r"^([-+]?)([0-9]*)[.]?([0-9]*)(?:[eE]([-+]?[0-9]+))?$"

    def parts(text: Column) -> Column:
        names = ("sign", "whole", "fraction", "exponent")
        return F.struct(*[F.regexp_extract(text, pattern, i).alias(name) for i, name in enumerate(names, 1)])

    def placed(p: Column) -> Column:
        shift = F.when(p["exponent"] == "", 0).otherwise(p["exponent"].try_cast("int"))
        known = (F.abs(shift) <= LONGEST_SHIFT) & (F.length(p["whole"]) + F.length(p["fraction"]) > 0)
        figures = F.concat(p["whole"], p["fraction"])
        return F.when(known, F.struct(p["sign"].alias("sign"), figures.alias("figures"), (F.length(p["whole"]) + shift).alias("point")))

    def sides(p: Column) -> Column:
        before = F.when(p["point"] > 0, F.rpad(F.left(p["figures"], p["point"]), p["point"], F.lit("0"))).otherwise("")
        rest = F.substring(p["figures"], F.greatest(p["point"], F.lit(0)) + 1, F.length(p["figures"]))
        after = F.concat(F.repeat(F.lit("0"), F.greatest(-p["point"], F.lit(0))), rest)
        trimmed = F.struct(p["sign"].alias("sign"), F.ltrim(before, F.lit("0")).alias("before"), F.rtrim(after, F.lit("0")).alias("after"))
        return F.when(p.isNotNull(), trimmed)

    def joined(p: Column) -> Column:
        text = F.concat(F.when(p["before"] == "", "0").otherwise(p["before"]), F.when(p["after"] == "", "").otherwise(F.concat(F.lit("."), p["after"])))
        return F.concat(F.when((p["sign"] == "-") & (F.concat(p["before"], p["after"]) != ""), "-").otherwise(""), text)

    return once(once(once(once(digits, parts), placed), sides), joined)


def order_key(exact: Column) -> Column:
    """A text that sorts as the canonical numbers do, whatever their length."""

    def keyed(text: Column) -> Column:
        bare = F.ltrim(text, F.lit("-"))
        whole = F.substring_index(bare, ".", 1)
        key = F.concat(F.lpad(F.length(whole).cast("string"), 9, "0"), whole, F.lit("."), F.regexp_extract(bare, "[.]([0-9]*)$", 1))
        # Of negative numbers the greater figures come first, and the longer of two that begin alike.
        turned = lambda k: F.concat(F.lit("-"), F.translate(k, "0123456789", "9876543210"), F.lit("~"))
        return F.when(F.startswith(text, F.lit("-")), turned(key)).otherwise(F.concat(F.lit("0"), key))

    return once(exact, keyed)


def exact_number(cell: Column) -> Column:
    """The number of :func:`parse_number` as canonical text with every digit, for what a stored number would round or not hold."""
    return exact_text(_digits(cell))


def exact_number_us_first(cell: Column) -> Column:
    """The number of :func:`parse_number_us_first` as canonical text with every digit."""
    return exact_text(_digits_us_first(cell))


def exact_wide_number(cell: Column) -> Column:
    """The number of :func:`parse_wide_number` as canonical text with every digit."""
    return exact_text(_wide_digits(cell))


def fits(exact: Column) -> Column:
    """Whether a stored number holds all digits of a canonical one."""
    return exact.rlike(r"^-?[0-9]{1,28}([.][0-9]{1,10})?$")


def _digits(cell: Column) -> Column:
    text = F.regexp_replace(F.translate(strip(cell.cast("string")), "  ", ""), "%$", "")
    return (
        F.when(text.rlike(_whole(BR_GROUPED, BR_DECIMAL)), _comma_to_dot(_no_dots(text)))
        .when(text.rlike(_whole(US_GROUPED)), _no_commas(text))
        .when(text.rlike(_whole(PLAIN)), text)
    )


def parse_number(cell: Column) -> Column:
    """Number of a text cell, regional reading first: ``1.234`` is 1234 and ``1,234`` is 1.234."""
    return _digits(cell).try_cast(STORED)


def _digits_us_first(cell: Column) -> Column:
    text = F.regexp_replace(cell.cast("string"), r"[\s%]", "")
    return (
        F.when(text.rlike(_whole(US_GROUPED)), _no_commas(text))
        .when(text.rlike(_whole(BR_GROUPED, BR_DECIMAL)), _comma_to_dot(_no_dots(text)))
        .when(text.rlike(r"^-?([0-9]*[.])?[0-9]+$"), text)
    )


def parse_number_us_first(cell: Column, longest: int | None = None) -> Column:
    """Number of a text cell, US grouping first: ``1,234`` is 1234; no scientific notation, no text above ``longest`` characters."""
    number = _digits_us_first(cell).try_cast(STORED)
    return number if longest is None else F.when(F.length(F.btrim(cell.cast("string"))) <= longest, number)


def _wide_digits(cell: Column) -> Column:
    text = cell_text(cell)
    bare = F.rtrim(text, F.lit("%"))
    return (
        F.when(text.rlike("^(" + BR_GROUPED + "%?|" + BR_DECIMAL + "%?)$"), _comma_to_dot(_no_dots(bare)))
        .when(text.rlike("^" + SIMPLE + "%?$"), bare)
    )


def parse_wide_number(cell: Column) -> Column:
    """Number of a cell of a period column: regional or plain decimal, a trailing ``%`` allowed."""
    return _wide_digits(cell).try_cast(STORED)


def parse_plain_or_regional(cell: Column) -> Column:
    """Number of an untouched cell in the plain or the regional notation only: no grouping by commas, percent sign or exponent."""
    text = F.btrim(cell)
    digits = F.when(text.rlike(_whole(BR_GROUPED, BR_DECIMAL)), _comma_to_dot(_no_dots(text))).when(text.rlike(_whole(SIMPLE)), text)
    return digits.try_cast(STORED)


def looks_numeric(cell: Column) -> Column:
    """Whether a grid cell reads as a number, in either notation."""
    text = F.replace(strip(cell), F.lit(" "), F.lit(""))
    last_comma = F.length(text) - F.instr(F.reverse(text), ",")
    last_dot = F.length(text) - F.instr(F.reverse(text), ".")
    has_both = F.contains(text, F.lit(",")) & F.contains(text, F.lit("."))
    plain = (
        F.when(has_both & (last_comma > last_dot), _comma_to_dot(_no_dots(text)))
        .when(has_both, _no_commas(text))
        .otherwise(_comma_to_dot(text))
    )
    return F.coalesce(plain.rlike(GRID_NUMBER), F.lit(False))


def _filter_digits(text: Column) -> Column:
    plain = _comma_to_dot(strip(text))
    return F.when(plain.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), plain)


def filter_number(text: Column) -> Column:
    """Number a row filter reads; comma counts as decimal point; null when it is not a finite number."""
    return _filter_digits(text).try_cast(STORED)


def filter_key(text: Column) -> Column:
    """What row filters compare: a key that sorts numbers exactly, however small or long; null when the text is no number."""
    return order_key(exact_text(_filter_digits(text)))


def short_number(text: Column) -> Column:
    """The number of :func:`filter_key` as a decimal where it is written plainly and shortly, null elsewhere.

    Such numbers compare as decimals exactly as their keys do, at a small part of the cost.
    """
    plain = _comma_to_dot(strip(text))
    return F.when(plain.rlike(r"^-?[0-9]{1,18}([.][0-9]{1,10})?$"), plain).cast("decimal(28,10)")


def number_text(value: Column) -> Column:
    """Canonical text of a stored number: no exponent, no trailing zeros."""
    text = value.cast(STORED).cast("string")
    return F.when(value == 0, F.lit("0")).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def ratio(numerator: Column, denominator: Column, multiplier: float | Column = 1) -> Column:
    """numerator / denominator × multiplier as double; null where a side is missing or the denominator is 0."""
    factor = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return F.try_divide(numerator.cast("double"), denominator.cast("double")) * factor.cast("double")


def clamp(value: Column, minimum: float | None = None, maximum: float | None = None) -> Column:
    """Limit a value to the given bounds; missing values stay missing."""
    limited = value
    if maximum is not None:
        limited = F.when(limited > F.lit(maximum), F.lit(maximum)).otherwise(limited)
    if minimum is not None:
        limited = F.when(limited < F.lit(minimum), F.lit(minimum)).otherwise(limited)
    return limited
