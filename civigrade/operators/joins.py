"""Joins, latest rows, upserts and numbering that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of a row in a broadcast hash table for each byte the statistics give it: files are compressed, short texts and headers are not.
HELD_FOR_PLANNED = 16
NUMBERING_BLOCK = 65_536
MOST_HELD = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read by fewer tasks than the cluster has cores (one file, one block, gzip), spread over all.

    A table of many blocks is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def planned_bytes(df: DataFrame) -> int:
    """Size of a table by the optimiser's statistics (file sizes for stored tables); nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _nodes(plan) -> Iterator:
    yield plan
    inputs = plan.children()
    for place in range(inputs.size()):
        yield from _nodes(inputs.apply(place))


def _length(generate) -> int | None:
    """Number of rows an unfolded array makes of one; None where the plan does not tell."""
    array = generate.generator().children().apply(0)
    kind = array.getClass().getSimpleName()
    if kind == "CreateArray":
        return array.children().size()
    if kind == "Literal" and array.dataType().typeName() == "array":
        return 0 if array.value() is None else array.value().numElements()
    return None


def held_bytes(df: DataFrame) -> int | None:
    """Size of a table in the memory of the driver and of every executor, were it broadcast; None where the plan cannot tell. Nothing is run.

    The optimiser's statistics are sizes of compressed files and take an unfolded array for one row. Those of joins are products of
    sizes, which are ample as they are.
    """
    size, joined = planned_bytes(df), False
    for node in _nodes(df._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() == "Generate":
            length = _length(node)
            if length is None:
                return None
            size *= max(1, length)
        elif node.nodeName() == "Join" and node.joinType().sql() not in ("LEFT SEMI", "LEFT ANTI"):
            joined = True
    return size if joined else size * HELD_FOR_PLANNED


def lookup(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a catalog for broadcast if the plan bounds what it takes in memory by ``size`` bytes.

    Beyond it, and for tables whose size the plan cannot bound, the join shuffles; adaptive execution then broadcasts what turns out
    small and splits the partitions of hot keys. Where Spark would broadcast it all the same, by the sizes of compressed files, it is
    told to shuffle.
    """
    held = held_bytes(df)
    if held is not None and held <= size:
        return F.broadcast(df)
    if held is not None and held <= BROADCAST_BYTES:
        return df
    usual = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df.hint("shuffle_merge") if planned_bytes(df) <= usual else df


def attach_counted(df: DataFrame, counted: DataFrame, keys: list[str], null_keys: bool = True) -> DataFrame:
    """Join rows with a table that has one row for every key of ``df``.

    A key may have a third of all rows: its partner is a single row, so adaptive execution splits the rows of its partition. Where no
    key is null, say so: it saves work.
    """
    values = [c for c in counted.columns if c not in keys]
    partners = counted.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *values)
    return df.join(partners, _matches(keys, "_key_", null_keys)).select(*df.columns, *values)


def _matches(keys: list[str], prefix: str, null_keys: bool) -> Column:
    pairs = [(F.col(k), F.col(prefix + k)) for k in keys]
    return reduce(Column.__and__, [a.eqNullSafe(b) if null_keys else a == b for a, b in pairs])


def first_per_key(df: DataFrame, keys: list[str], *order: Column, rows: int = 1) -> DataFrame:
    """The first ``rows`` rows of every key. Spark limits every task's rows per key before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_position", F.row_number().over(window)).filter(F.col("_position") <= rows).drop("_position")


def few_per_key(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """The rows that can be among the first ``rows`` of their key by the columns ``order`` (ascending, nulls first).

    Every task keeps its own first rows batch by batch, so it never sorts all it reads. Where keys are many, what is held goes on
    and is begun anew; :func:`first_per_key` decides among the few.
    """

    def firsts(table: pa.Table) -> pa.Table:
        by = [(name, "ascending") for name in [*keys, *order]]
        table = table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_start"))
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for name in keys:
            codes = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        place = np.arange(table.num_rows)
        return table.filter(pa.array(place - place[new][np.cumsum(new) - 1] < rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = pa.Table.from_batches([batch])
            held = firsts(found if held is None else pa.concat_tables([held, found]))
            if held.num_rows > MOST_HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return df.mapInArrow(run, df.schema)


def latest(df: DataFrame, keys: list[str], period: str, tie_break: list[str]) -> DataFrame:
    """Latest row per key; a missing value counts like any other."""
    return first_per_key(df, keys, F.col(period).desc(), *[F.col(c).asc() for c in tie_break])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Union that keeps, per key, the last incoming row, else the current one. ``order`` sorts incoming rows."""
    order = order or []
    tagged = current.withColumn("_incoming", F.lit(0)).unionByName(
        incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True
    )
    last = [F.col("_incoming").desc(), *[F.col(c).desc() for c in order]]
    return first_per_key(tagged, keys, *last).drop("_incoming")


def prefix_sums(counted: DataFrame, group: list[str], order: Column, count: str, alias: str) -> DataFrame:
    """Sum of ``count`` over the rows before each row. For tables of counts, not for facts."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(alias, F.coalesce(F.sum(count).over(window), F.lit(0)))


def rows_before(df: DataFrame, group: list[str], position: str, then: list[str], weight: Column, alias: str) -> DataFrame:
    """Sum of ``weight`` over the rows of the group before each row, by ``position`` and ``then``, without one task per group.

    ``position`` is a number; sums run inside blocks of 65,536 positions. The sums of earlier blocks are added, themselves summed inside
    and over groups of 65,536 blocks.
    """
    blocked = df.withColumns({"_block": F.floor(F.col(position) / NUMBERING_BLOCK), "_weight": weight.cast("long")})
    keys = [*group, "_block"]
    sums = blocked.groupBy(*keys).agg(F.sum("_weight").alias("_rows"))
    sums = sums.withColumn("_super", F.floor(F.col("_block") / NUMBERING_BLOCK))
    supers = sums.groupBy(*group, "_super").agg(F.sum("_rows").alias("_super_rows"))
    supers = prefix_sums(supers, group, F.col("_super"), "_super_rows", "_super_before").drop("_super_rows")
    near = prefix_sums(sums, [*group, "_super"], F.col("_block"), "_rows", "_near")
    offsets = near.join(supers, _same(near, supers, [*group, "_super"])).select(
        *[near[k] for k in keys], (F.col("_near") + F.col("_super_before")).alias("_before")
    )
    inside = Window.partitionBy(*keys).orderBy(position, *then).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return (
        placed.join(offsets, _same(placed, offsets, keys), "left")
        .withColumn(alias, F.col("_before") + F.col("_inside"))
        .select(*[placed[c] for c in df.columns if c != alias], alias)
    )


def number_rows(df: DataFrame, group: list[str], position: str, then: list[str], alias: str = "row_number") -> DataFrame:
    """``row_number`` per group ordered by ``position`` and ``then``, without one task per group."""
    return rows_before(df, group, position, then, F.lit(1), alias).withColumn(alias, F.col(alias) + 1)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])
