"""Records of delimited files whose quoted cells hold line breaks, cut by every task at once.

A line alone does not tell whether it begins inside a quoted cell. But it tells where it would end: for both beginnings, outside and
inside, whether its end lies inside. That is a function on two states, and such functions compose in any grouping. So the lines of
every chunk of a file block (at most 65,536 lines, so that no task holds a whole block) are composed on their own; the chunks of a
file, one row each, are composed in order; and then every line knows its
state. A line that begins outside starts a record, the lines that follow inside belong to it. Only the lines of broken records are
brought together; all other lines stay where they are.

A quote opens a cell only where the cell begins with it, two in a row are one quote, and what follows a closing quote up to the
separator belongs to the cell, as in Spark's own reader. Files are split at line feeds; a carriage return stays part of the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["__file", "__block"]
CHUNK = [*BLOCK, "__chunk"]
#: A chunk holds at most two to this power lines.
CHUNK_BITS = 16


def chunk_of(at: str) -> Column:
    """The chunk of a running row number: chunks are consecutive, and in the order of the rows."""
    return F.shiftright(F.col(at), CHUNK_BITS).alias("__chunk")


def ends_inside(line: Column, separator: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell if it begins outside, and if it begins inside."""
    cut = re.escape(separator)
    quoted = '[^"]*+(?:""[^"]*+)*+'
    whole = f'(?:(?:"{quoted}"[^{cut}]*+|[^"{cut}][^{cut}]*+)?+{cut})*+'
    left_open = f'{whole}"{quoted}\\z'
    has_quote = F.contains(line, F.lit('"'))
    outside = has_quote & line.rlike(f"^{left_open}")
    inside = ~has_quote | line.rlike(f"^{quoted}\\z") | line.rlike(f'^{quoted}"[^{cut}]*+{cut}{left_open}')
    return outside, inside


def _composed(constant: Column, swaps: Column, order) -> tuple[Column, Column]:
    """Last constant of a running composition (null if it has none yet), as it is without the swaps, and the parity of all swaps."""
    parity = F.coalesce(F.sum(swaps).over(order), F.lit(0)) % 2
    return F.last(constant, ignorenulls=True).over(order), parity


def _functions(lines: DataFrame, separator: str) -> DataFrame:
    """Every line's function: ``constant`` (0 or 1, null if the beginning matters) and ``swap`` (1 if it turns the state over)."""
    outside, inside = (state.cast("int") for state in ends_inside(F.col("line"), separator))
    known = lines.withColumns({"_outside": outside, "_inside": inside})
    constant = F.when(F.col("_outside") == F.col("_inside"), F.col("_outside"))
    return known.withColumns({"constant": constant, "swap": F.when(F.col("_outside") > F.col("_inside"), 1).otherwise(0)}).drop("_outside", "_inside")


def _running(rows: DataFrame, group: list[str], order: str, value: Column, swaps: Column) -> DataFrame:
    """``base`` and ``turned`` of the composition of all rows before each row: the state is base (or the first state) turned over."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_turns", F.sum(swaps).over(upto) % 2)
    # A constant is kept as what it would be without the turns counted so far, so that later turns apply to it alone.
    counted = counted.withColumn("_constant", F.when(value.isNotNull(), (value + F.col("_turns")) % 2))
    base, turned = _composed(F.col("_constant"), swaps, before)
    return counted.withColumns({"base": base, "turned": turned}).drop("_turns", "_constant")


def whole_records(lines: DataFrame, separator: str) -> DataFrame:
    """Records of ``lines`` (__file, __block, __at, line): the order columns of the first line, ``number`` in its block, and ``record``."""
    known = _functions(lines.withColumn("__chunk", chunk_of("__at")), separator)
    inside = _running(known, CHUNK, "__at", F.col("constant"), F.col("swap"))
    start_if = lambda first: F.sum(((F.coalesce("base", F.lit(first)) + F.col("turned")) % 2 == 0).cast("int"))
    last = F.struct("__at", F.coalesce(F.col("constant"), F.col("base")).alias("base"), "turned", "swap", "constant")
    # One row for each chunk: its function, and how many records start in it for both beginnings.
    chunks = inside.groupBy(*CHUNK).agg(start_if(0).alias("starts_0"), start_if(1).alias("starts_1"), F.max(last).alias("_last"))
    from_line = F.col("_last.constant")
    value = F.when(from_line.isNotNull(), from_line).otherwise((F.col("_last.base") + F.col("_last.turned") + F.col("_last.swap")) % 2)
    turns = F.when(value.isNull(), (F.col("_last.turned") + F.col("_last.swap")) % 2).otherwise(0)
    chunks = chunks.withColumns({"_value": value, "_swaps": turns, "_place": F.struct("__block", "__chunk")})
    chunks = _running(chunks, ["__file"], "_place", F.col("_value"), F.col("_swaps"))
    chunks = chunks.withColumn("enters", (F.coalesce("base", F.lit(0)) + F.col("turned")) % 2)
    chunks = chunks.withColumn("starts", F.when(F.col("enters") == 0, F.col("starts_0")).otherwise(F.col("starts_1")))
    of_block = Window.partitionBy(*BLOCK).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("earlier", F.coalesce(F.sum("starts").over(of_block), F.lit(0)))
    before = Window.partitionBy("__file").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.struct(F.col("__block").alias("block"), (F.col("earlier") + F.col("starts")).alias("number"))
    owner = F.last(F.when(F.col("starts") > 0, owner), ignorenulls=True).over(before)
    chunks = chunks.select(*CHUNK, "enters", "earlier", owner.alias("owner"))
    placed = inside.join(chunks, CHUNK).withColumn("state", (F.coalesce("base", "enters") + F.col("turned")) % 2)
    upto = Window.partitionBy(*CHUNK).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_started", F.sum((F.col("state") == 0).cast("int")).over(upto))
    placed = placed.withColumn("number", F.col("earlier") + F.col("_started"))
    ends = F.when(F.col("constant").isNotNull(), F.col("constant")).otherwise((F.col("state") + F.col("swap")) % 2)
    placed = placed.withColumn("is_whole", (F.col("state") == 0) & (ends == 0))
    single = placed.filter("is_whole").select(*BLOCK, "__at", "number", F.col("line").alias("record"))
    carried = F.col("_started") == 0
    parts = placed.filter(~F.col("is_whole")).select(
        "__file", F.when(carried, F.col("owner.block")).otherwise(F.col("__block")).alias("__block"),
        F.when(carried, F.col("owner.number")).otherwise(F.col("number")).alias("number"), F.struct(F.col("__block").alias("b"), F.col("__at").alias("a"), "line").alias("part"),
    )
    ordered = F.sort_array(F.collect_list("part"))
    broken = parts.groupBy(*BLOCK, "number").agg(F.min("part.a").alias("__at"), F.array_join(F.transform(ordered, lambda p: p["line"]), "\n").alias("record"))
    return single.unionByName(broken)
