"""Sharding along a Hilbert curve.

Each metadata dimension is cut into 2**bits cells of about equally many rows. The cells of a row are a point, its place on the
Hilbert curve through all points is the row's index, and rows in the order of that index are cut into runs. Neighbours on the curve
are neighbours in every dimension, so each run (and each file in it) covers a small box and filters on any of the dimensions skip
most of them. ``file_boxes`` tells the box of every shard.

Rows are ordered by one range exchange on (index, id, digest) and written once; a row's number is its place in its partition plus the
rows before that partition. The only thing that comes to the driver is one count per partition and the cell borders (bounded by
2**bits per dimension).

Defined results: a null value is a cell of its own below all others; ties of the whole order are rows that cannot be told apart, in
any order; an empty table gives no rows; columns with the names of the added ones are replaced, all others come back as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.session import materialise

BITS = 5
SHARDS = 16
ACCURACY = 10_000


def text_order(value: Column) -> Column:
    """A number in the order of texts: their first seven UTF-8 bytes."""
    head = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def borders(rows: DataFrame, dimensions: Mapping[str, Column], bits: int) -> dict[str, list[int]]:
    """Upper borders of the lower cells of each dimension: quantiles from one mergeable sketch per dimension."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    sketches = [F.percentile_approx(value.cast("long"), shares, ACCURACY).alias(name) for name, value in dimensions.items()]
    found = rows.agg(*sketches).first()
    return {name: sorted(found[name] or []) for name in dimensions}


def cell(value: Column, upper: list[int], bits: int) -> Column:
    """0 for null, else 1 + the number of borders below the value, at most 2**bits - 1."""
    below = F.lit(0)
    for border in upper:
        below = below + (value > border).cast("int")
    return F.when(value.isNull(), 0).otherwise(F.least(below + 1, F.lit((1 << bits) - 1)))


def curve_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with coordinates of ``bits`` bits, by Skilling's transposed form.

    The steps are unrolled to bit operations on columns; ``axes`` is an array column that each step rewrites.
    """
    n = len(cells)
    axes = F.array(*[c.cast("long") for c in cells])
    for level in range(bits - 1, 0, -1):
        for i in range(n):
            axes = F.transform(F.array(axes), turning(i, n, level))[0]
    return interleaved(axes, n, bits)


def turning(i: int, n: int, level: int) -> Callable[[Column], Column]:
    return lambda a: turned(a, i, n, level, (1 << level) - 1)


def turned(a: Column, i: int, n: int, level: int, mask: int) -> Column:
    """Undo the excess work of one axis at one level: invert the low bits of axis 0, or exchange them with axis i."""
    swap = a[0].bitwiseXOR(a[i]).bitwiseAND(F.lit(mask))
    flagged = F.shiftright(a[i], level).bitwiseAND(F.lit(1)) == 1
    first = F.when(flagged, a[0].bitwiseXOR(F.lit(mask))).otherwise(a[0].bitwiseXOR(swap))
    if i == 0:
        return F.array(F.when(flagged, a[0].bitwiseXOR(F.lit(mask))).otherwise(a[0]), *[a[j] for j in range(1, n)])
    other = F.when(flagged, a[i]).otherwise(a[i].bitwiseXOR(swap))
    return F.array(first, *[other if j == i else a[j] for j in range(1, n)])


def interleaved(axes: Column, n: int, bits: int) -> Column:
    """Gray code of the axes, read bit by bit across the axes."""

    def read(a: Column) -> Column:
        gray = [a[0]]
        for i in range(1, n):
            gray.append(a[i].bitwiseXOR(gray[i - 1]))
        flip = F.lit(0).cast("long")
        for level in range(bits - 1, 0, -1):
            odd = F.shiftright(gray[n - 1], level).bitwiseAND(F.lit(1))
            flip = flip.bitwiseXOR(odd * F.lit((1 << level) - 1))
        place = F.lit(0).cast("long")
        for level in range(bits - 1, -1, -1):
            for value in gray:
                place = F.shiftleft(place, 1) + F.shiftright(value.bitwiseXOR(flip), level).bitwiseAND(F.lit(1))
        return place

    return F.transform(F.array(axes), read)[0]


def along_curve(docs: DataFrame, dimensions: Mapping[str, Column], ties: list[str], bits: int = BITS) -> DataFrame:
    """Every row as a struct ``row`` with its ``curve_index`` and ``curve_rank``, its gapless number along the curve, and ``n_rows``.

    ``dimensions`` names order-preserving numbers of the metadata columns; ``ties`` orders rows of one curve index. Rows are written
    once, in that order.
    """
    upper = borders(docs, dimensions, bits)
    numbers = [value.cast("long").alias(f"number_{i}") for i, value in enumerate(dimensions.values())]
    held = docs.select(F.struct(*docs.columns).alias("row"), *numbers)
    cells = [cell(F.col(f"number_{i}"), upper[name], bits) for i, name in enumerate(dimensions)]
    order = ["curve_index", *[F.col("row")[c] for c in ties]]
    indexed = held.select("row", curve_index(cells, bits).alias("curve_index"))
    placed = indexed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    written = materialise(placed, "curve").withColumn("part", F.shiftright("place", 33))
    counts = sorted((r["part"], r["n"]) for r in written.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for number, n in counts:
        offsets.append((number, total))
        total += n
    # One row per written partition; a join keeps the plan small when there are many.
    before = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(before, "part").select("row", "curve_index", rank.alias("curve_rank"), F.lit(total).cast("long").alias("n_rows"))


def sharded(docs: DataFrame, dimensions: Mapping[str, Column], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``docs`` with ``curve_index``, ``shard`` (0 to shards - 1) and ``slot``, the gapless place in the shard.

    Shards are runs of the curve whose numbers of rows differ by one at most.
    """
    shard = F.expr(f"cast(((curve_rank + 1) * {shards}L - 1) div n_rows AS int)")
    cut = along_curve(docs, dimensions, ties, bits).withColumn("shard", shard)
    slot = F.expr(f"curve_rank - (shard * n_rows) div {shards}L").alias("slot")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("curve_index", "shard", "slot")]
    return cut.select(*kept, "curve_index", "shard", slot)


def file_boxes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column in each shard: what a reader needs to skip shards."""
    ends = [f(c).alias(f"{side}_{c}") for c in columns for side, f in (("least", F.min), ("greatest", F.max))]
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)


def write_shards(rows: DataFrame, folder: str) -> None:
    """One folder per shard, its files in slot order."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def measured(docs: DataFrame) -> DataFrame:
    """Documents with their size (bytes of the text, and one) and the digest of the text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.withColumns({"size": size, "text_crc32": F.crc32(F.coalesce("text", F.lit("")))})


def by_metadata(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``measured`` rows sharded by language, source and size; ties by doc_id, then by size and digest."""
    dimensions = {"lang": text_order(F.col("lang")), "source": text_order(F.col("source")), "size": F.col("size")}
    return sharded(rows, dimensions, ["doc_id", "size", "text_crc32"], shards)


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Whole documents in their shards."""
    return by_metadata(measured(docs), shards)
