"""Whole rows packed into blocks that later passes meet again without a shuffle of texts.

Several operators read every text, ask the cluster something about what the text holds, and then need the same rows next to the
answers. ``pack`` writes the rows once: each scan task packs consecutive rows into blocks of bounded size (Arrow, zstd) and the
table is bucketed by block. ``each`` and ``answered`` run a function on one block at a time; only questions and answers shuffle.

A row is named by (block, place); that name is unique also where ids repeat or are null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from civigrade.llm.spans import sliced
from civigrade.session import scratch_folder

BLOCK_BYTES = 4 << 20
PACKED = "block long, n_rows long, n_bytes long, packed binary"
ZSTD_LEVEL = 5


@dataclass(frozen=True)
class Blocks:
    """A written table of blocks; ``columns`` is the schema of the rows inside."""

    table: DataFrame
    columns: StructType
    count: int
    rows: int
    text_bytes: int

    def each(self, function: Callable[[int, pa.Table], Iterator[pa.Table] | pa.Table], schema: str) -> DataFrame:
        """``function(block, rows)`` for every block."""

        def run(packed: pa.Table) -> pa.Table:
            return function(packed["block"][0].as_py(), unpacked(packed))

        return self.table.groupBy("block").applyInArrow(run, schema)

    def chosen(self, places: DataFrame) -> DataFrame:
        """The rows named by (block, place), each as often as it is named, with all their columns."""

        def take(_: int, rows: pa.Table, own: pa.Table) -> pa.Table:
            return rows.take(own["place"].combine_chunks().sort())

        return self.answered(places, take, self.columns)

    def answered(self, answers: DataFrame, function: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
        """``function(block, rows, answers)`` for every block; ``answers`` has a column ``block`` and is empty for some blocks."""
        empty = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()

        def run(packed: pa.Table, own: pa.Table) -> pa.Table:
            if packed.num_rows == 0:
                return empty
            return function(packed["block"][0].as_py(), unpacked(packed), own)

        return self.table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a flat schema text such as ``a long, b string`` (tasks have no session that could parse it)."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.strip().split(" ", 1) for field in schema.split(","))])


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def squeezed(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def spread(packed: bytes, kind: type, size: int) -> np.ndarray:
    """``size`` numbers from their compressed bytes."""
    return np.frombuffer(pa.Codec("zstd").decompress(packed, size * np.dtype(kind).itemsize, asbytes=True), kind)


def packed_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD_LEVEL))
    with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(packed: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(packed["packed"][0].as_buffer()).read_all()


def pack(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write all columns of ``docs`` in blocks of at most ``block_bytes`` of text (a longer text fills a block of its own)."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            numbers = {"block": first + number, "n_rows": rows.num_rows, "n_bytes": size}
            columns = {name: pa.array([value], pa.int64()) for name, value in numbers.items()}
            return pa.RecordBatch.from_pydict(columns | {"packed": pa.array([packed_rows(rows)], pa.binary())})

        for batch in sliced(batches, text, block_bytes // 8):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
            if size >= block_bytes:
                yield block()
                number, held, size = number + 1, [], 0
        if held:
            yield block()

    folder = scratch_folder(spark, "blocks")
    name = f"blocks_{uuid.uuid4().hex}"
    (
        docs.mapInArrow(run, PACKED)
        .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
        .option("path", folder)
        .option("compression", "none")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(32 << 20))
        .option("parquet.page.size.row.check.min", "1")
        .option("parquet.block.size.row.check.min", "1")
        .saveAsTable(name)
    )
    table = spark.table(name)
    total = table.selectExpr("count(*) AS n", "coalesce(sum(n_rows), 0) AS n_rows", "coalesce(sum(n_bytes), 0) AS n_bytes").first()
    return Blocks(table, docs.schema, total["n"], total["n_rows"], total["n_bytes"])
