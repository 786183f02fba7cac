"""Pages of an ordered table that is written once: a page opens the ranges that hold it, however deep it lies.

Rows are dealt to ranges of about ``range_rows`` in their order, and every row is written with its place in its range. A small table
has the number of rows and the first key of every range (an order statistic of the whole). Page ``offset, limit`` adds the numbers up
to find its ranges; the page after a given row finds them by the first keys. Nothing is sorted again but the rows of a page.

The driver holds the small table: one row for each ``range_rows`` rows, but no more than ``MOST_RANGES`` as long as ranges of
``RANGE_ROWS`` rows can hold the table. So short ranges grow with a large table, and not their number, their files, and the sample of
keys that the driver draws range borders from.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

RANGE_ROWS = 65_536
MOST_RANGES = 512
#: The lower bits of a task's running row number.
ROW_BITS = (1 << 33) - 1


@dataclass(frozen=True)
class Pages:
    """An ordered table below ``root``: ``rows`` by range, ``ranges`` with counts and first keys; ``keys`` are the order's columns."""

    spark: SparkSession
    root: str
    columns: StructType
    keys: tuple[str, ...]

    def _ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/ranges").orderBy("range")

    def _rows(self, ranges: list[int]) -> DataFrame:
        schema = StructType([*self.columns]).add("_at", "long").add("range", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows").filter(F.col("range").isin(ranges))

    def _in_order(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy("range", "_at").select(*[c for c in self.columns.names if c not in self.keys])

    def total(self) -> int:
        return self._ranges().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in their order."""
        if limit < 1 or offset < 0:
            raise ValueError("a page needs a positive limit and an offset that is not negative")
        found = [(row["range"], row["n"]) for row in self._ranges().select("range", "n").collect()]
        ends = list(accumulate(n for _, n in found))
        first = bisect_right(ends, offset)
        last = min(bisect_right(ends, offset + limit - 1), len(found) - 1)
        own, within = [], F.lit(False)
        for place in range(first, last + 1):
            number, before = found[place][0], ends[place] - found[place][1]
            own.append(number)
            within = within | ((F.col("range") == number) & (F.col("_at") >= offset - before) & (F.col("_at") < offset + limit - before))
        return self._in_order(self._rows(own).filter(within))

    def after(self, row: dict, limit: int) -> DataFrame:
        """The ``limit`` rows that follow ``row`` (the values of the order's keys), whether the table has it or not."""
        if limit < 1:
            raise ValueError("a page needs a positive limit")
        # The keys take the types of the table's columns; nulls come first, as in the order of structs.
        kinds = {f.name: f.dataType for f in self.columns}
        asked = F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in self.keys])
        found = self._ranges().select("range", "n", (F.struct(*self.keys) <= asked).alias("is_before")).collect()
        start = max(0, sum(r["is_before"] for r in found) - 1)
        own, later = [], 0
        for place, r in enumerate(found[start:]):
            own.append(r["range"])
            later += r["n"] if place else 0
            if later >= limit:
                break
        rows = self._rows(own).filter(F.struct(*self.keys) > asked)
        return self._in_order(rows.orderBy("range", "_at").limit(limit))


def build(rows: DataFrame, order: dict[str, Column], root: str, range_rows: int = RANGE_ROWS) -> Pages:
    """Write ``rows`` in the order of the named columns ``order`` (ascending, nulls first; give a number negated to go down).

    The order must tell rows apart, or rows that are equal in it come in any order among themselves.
    """
    spark = rows.sparkSession
    keyed = rows.select("*", *[value.alias(name) for name, value in order.items()])
    count = keyed.count()
    ranges = max(1, -(-count // max(range_rows, min(RANGE_ROWS, -(-count // MOST_RANGES)))))
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = ordered.withColumns({"range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))})
    placed.write.partitionBy("range").parquet(f"{root}/rows")
    schema = StructType([StructField(f.name, f.dataType) for f in keyed.schema])
    written = spark.read.schema(StructType([*schema]).add("_at", "long").add("range", "integer")).parquet(f"{root}/rows")
    firsts = written.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*order), "_at").alias("k")).select("range", "n", "k.*")
    firsts.coalesce(1).write.parquet(f"{root}/ranges")
    return Pages(spark, root, schema, tuple(order))


def pages_of_ranking(ranked: DataFrame, score: str, name: Column, code: str, root: str, range_rows: int = RANGE_ROWS) -> Pages:
    """Pages of a ranking by falling score, then name and code."""
    return build(ranked, {"_k_score": -F.col(score), "_k_name": name, "_k_code": F.col(code)}, root, range_rows)


def pages_of_serving(rows: DataFrame, root: str, range_rows: int = RANGE_ROWS) -> Pages:
    """Pages of serving rows, newest period first, then by id."""
    return build(rows, {"_k_period": -F.unix_date("reference_period"), "_k_id": F.col("id")}, root, range_rows)
