"""Exact deduplication against history with a sharded minimal perfect hash.

``index_history`` reduces the history to one row per distinct digest (its winner and its size) and builds, for every shard of the
digest space, a minimal perfect hash: levels of bit arrays that hold the digests without a collision at that level, so that the rank
of a digest's bit is its slot. Slots hold the full digest and the locator of the winner. A lookup computes the slot of a digest and
compares all 32 bytes there; only equal bytes make it a member. ``deduplicate`` looks up the distinct digests of a batch, merges
members with the slot's group, groups nonmembers among themselves, and tells every row of both its group.

Rows of one text meet only as partial aggregates, so a group that holds a third of all rows is one row per task. Shards are cut by
digest and hold a bounded number of digests; their number follows the input.

Defined results: a null text counts as empty, and all empty texts are equal; of equal texts the one with most code points, then the
smallest doc_id, stays (a null doc_id comes last); rows that repeat a doc_id are told the same group, and all rows that carry the
winning doc_id and digest are marked as kept; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.llm.spans import mixed
from civigrade.session import materialise

SHARD_DIGESTS = 8_192
SPACE_PER_DIGEST = 2
MAX_LEVELS = 200
BLANKS = " \t\n\x0b\x0c\r"
INDEX = "shard long, n_slots long, levels binary, level_sizes array<long>, digests binary, n_points binary, doc_ids binary, sizes binary"
FOUND = "digest binary, member boolean, keep_points long, keep_id long, group_size long"
NO_ID = np.iinfo(np.int64).max


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def digested(docs: DataFrame, historical: Column) -> DataFrame:
    """doc_id (null as the largest number), digest, code points and side of every row; no text goes further than its scan."""
    return docs.select(
        historical.alias("historical"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        digest_of(F.col("text")).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: its winner and the number of rows."""
    winner = F.min(F.struct((-F.col("n_points")).alias("less"), "doc_id"))
    return (
        rows.groupBy("digest")
        .agg(winner.alias("w"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", (-F.col("w.less")).alias("keep_points"), F.col("w.doc_id").alias("keep_id"), "group_size")
    )


def shard_of(digest: Column, shards: int) -> Column:
    """The shard by the first 60 bits of the digest."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long") % shards


def level_bits(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest in the array of a level; ``words`` are the last 128 bits as two numbers."""
    return (mixed(words[:, 0] + mixed(words[:, 1] ^ np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


def digest_words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, 16:]).view(np.uint64)


def build(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of all levels, and the slot of each of the distinct ``digests`` (rows of 32 bytes)."""
    words, rest, levels = digest_words(digests), np.arange(len(digests)), []
    slots, taken = np.empty(len(digests), dtype=np.int64), 0
    while len(rest):
        if len(levels) == MAX_LEVELS:
            raise ValueError("digests are not distinct")
        size = max(64, SPACE_PER_DIGEST * len(rest))
        bits = level_bits(words[rest], len(levels), size)
        single = np.bincount(bits, minlength=size) == 1
        alone = single[bits]
        slots[rest[alone]] = taken + (np.cumsum(single) - 1)[bits[alone]]
        taken += int(single.sum())
        levels.append(single)
        rest = rest[~alone]
    return levels, slots


def slots_of(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 if no level knows its bit. A slot says nothing yet about membership."""
    words, rest, taken = digest_words(digests), np.arange(len(digests)), 0
    slots = np.full(len(digests), -1, dtype=np.int64)
    for number, single in enumerate(levels):
        bits = level_bits(words[rest], number, len(single))
        hit = single[bits]
        slots[rest[hit]] = taken + (np.cumsum(single) - 1)[bits[hit]]
        taken += int(single.sum())
        rest = rest[~hit]
    return slots


def digest_array(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def index_shard(rows: pa.Table) -> pa.Table:
    """The index of one shard as a single row; slot order everywhere."""
    digests = digest_array(rows["digest"])
    levels, slots = build(digests)
    order = np.argsort(slots)

    def in_slots(name: str) -> bytes:
        return rows[name].to_numpy()[order].astype(np.int64).tobytes()

    return pa.table(
        {
            "shard": rows["shard"].slice(0, 1),
            "n_slots": pa.array([len(digests)], pa.int64()),
            "levels": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "level_sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "n_points": pa.array([in_slots("keep_points")], pa.binary()),
            "doc_ids": pa.array([in_slots("keep_id")], pa.binary()),
            "sizes": pa.array([in_slots("group_size")], pa.binary()),
        }
    )


def look_up(index: pa.Table, asked: pa.Table) -> pa.Table:
    """Groups of one shard after the batch: slots, with the batch's members merged in, and the nonmembers' own groups."""
    digests = digest_array(asked["digest"])
    points, ids, sizes = (asked[name].to_numpy().copy() for name in ("keep_points", "keep_id", "group_size"))
    held = np.zeros((0, 32), np.uint8)
    held_points = held_ids = held_sizes = slots = np.zeros(0, np.int64)
    member = np.zeros(len(digests), dtype=bool)
    if index.num_rows:
        row = index.to_pylist()[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        held_points, held_ids, held_sizes = (np.frombuffer(row[name], np.int64).copy() for name in ("n_points", "doc_ids", "sizes"))
        edges = np.cumsum([0, *row["level_sizes"]])
        bits = np.unpackbits(np.frombuffer(row["levels"], np.uint8), count=int(edges[-1])).astype(bool)
        slots = slots_of([bits[a:b] for a, b in zip(edges, edges[1:])], digests)
        known = np.flatnonzero(slots >= 0)
        member[known] = (held[slots[known]] == digests[known]).all(axis=1)
        at, own = slots[member], np.flatnonzero(member)
        better = (points[own] > held_points[at]) | ((points[own] == held_points[at]) & (ids[own] < held_ids[at]))
        held_points[at], held_ids[at] = np.where(better, points[own], held_points[at]), np.where(better, ids[own], held_ids[at])
        held_sizes[at] += sizes[own]
    fresh = ~member
    whole = np.concatenate([held, digests[fresh]])
    return pa.table(
        {
            "digest": pa.array([x.tobytes() for x in whole], pa.binary()),
            "member": pa.array(np.arange(len(whole)) < len(held)),
            "keep_points": pa.array(np.concatenate([held_points, points[fresh]])),
            "keep_id": pa.array(np.concatenate([held_ids, ids[fresh]])),
            "group_size": pa.array(np.concatenate([held_sizes, sizes[fresh]])),
        }
    )


def index_history(history: DataFrame, shards: int) -> DataFrame:
    """The written index of ``digested`` rows: one row per shard."""
    sharded = groups_of(history).withColumn("shard", shard_of(F.col("digest"), shards))
    return materialise(sharded.groupBy("shard").applyInArrow(index_shard, INDEX), "digest-index")


def merged_groups(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """Every distinct digest of history and batch with its winner and size; ``member`` tells those that the index holds."""
    asked = groups_of(batch).withColumn("shard", shard_of(F.col("digest"), shards))
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(look_up, FOUND)


def deduplicate(docs: DataFrame, historical: Column, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and in_history for every row of ``docs`` (doc_id, text).

    ``historical`` is true for the rows that are the history; all other rows are the batch that is looked up in its index.
    """
    rows = materialise(digested(docs, F.coalesce(historical, F.lit(False))), "digests")
    distinct = rows.agg(F.approx_count_distinct("digest")).first()[0]
    shards = max(1, -(-distinct // shard_digests))
    index = index_history(rows.filter("historical"), shards)
    groups = materialise(merged_groups(index, rows.filter("NOT historical"), shards), "digest-groups")
    return rows.join(groups, "digest").select(
        F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("keep_id") < NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )
