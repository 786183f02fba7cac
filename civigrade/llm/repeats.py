"""Substring deduplication by level-wise doubling.

A passage repeats only if its halves repeat. So all windows of the shortest length are compared first, by hashes alone; only where
they repeat are windows of twice that length looked at, and so on up to the window asked for (the last step may be shorter than a
doubling). Windows that repeat at one length alone reach the next; the windows left at the last length are decided by documents.

Shuffles carry sorted hash arrays, one per block and bucket; answers are one bit per hash. Buckets are cut from the hash, and there
are as many as the number of windows asks for, so a very frequent passage is one hash per block and never a hot group.

Defined results: a null or empty text has no words; a text of fewer words than the window loses nothing; a null doc_id counts as
larger than any other; rows with equal ids do not remove each other's words; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civigrade.llm import spans
from civigrade.llm.blocks import Blocks, arrow_schema, pack, spread, squeezed
from civigrade.session import materialise

WINDOW = 13
#: Length of the first level; two such windows make the window asked for.
SHORTEST = 7
#: Hashes that one bucket is meant to hold; the number of buckets follows the input.
BUCKET_HASHES = 1_000_000
#: Used for the number of buckets only.
BYTES_PER_WORD = 6
LAST_ID = np.iinfo(np.int64).max
QUESTIONS = "bucket int, block long, size long, hashes binary, more binary, owners binary"
ANSWERS = "block long, level int, bucket int, marks binary"


def levels(window: int, shortest: int) -> list[int]:
    """Window lengths: each twice the one before, the last the window itself."""
    lengths = [window if shortest >= window else shortest]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


def scaled(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """hash * buckets / 2**32: the bucket in the high 32 bits, the next 32 bits of the hash below it, in the order of the hashes."""
    count, half = np.uint64(buckets), np.uint64(32)
    return (hashes >> half) * count + ((hashes & np.uint64(0xFFFFFFFF)) * count >> half)


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes."""
    return np.searchsorted((scaled(hashes, buckets) >> np.uint64(32)).astype(np.int64), np.arange(buckets + 1))


class Windows:
    """Word windows of one block, narrowed level by level with the answers received so far."""

    def __init__(self, rows: pa.Table):
        ids = rows["doc_id"].cast(pa.int64())
        self.ids = ids.fill_null(LAST_ID).to_numpy()
        self.offsets, self.data = spans.buffers(rows["text"])
        self.starts, self.ends, self.rows = spans.words(self.offsets, self.data)
        self.lanes: dict[int, np.ndarray] = {}
        self.alive: np.ndarray | None = None
        self.length = 0

    def hashes(self, length: int, at: np.ndarray, lane: int = 0) -> np.ndarray:
        if lane not in self.lanes:
            cuts = np.flatnonzero(np.diff(self.starts // spans.SLICE_BYTES)) + 1
            edges = [0, *cuts.tolist(), len(self.starts)]
            parts = [spans.word_hashes(self.data, self.starts[a:b], self.ends[a:b], lane) for a, b in zip(edges, edges[1:])]
            self.lanes[lane] = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return spans.window_hashes(self.lanes[lane], length)[at]

    def start(self, length: int) -> None:
        self.alive, self.length = np.flatnonzero(spans.windows_inside(self.rows, length)), length

    def narrow(self, length: int, repeated: np.ndarray) -> None:
        """Keep windows of ``length`` whose first and last part, of the former length, both repeat."""
        flags = np.zeros(len(self.starts) + 1, dtype=bool)
        flags[self.alive[repeated]] = True
        at = self.alive[repeated]
        at = at[at + length <= len(self.starts)]
        last = at + length - self.length
        self.alive = at[flags[last] & (self.rows[at] == self.rows[at + length - 1])]
        self.length = length

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the live windows, the place of each window among them, and how often each occurs."""
        found, place, count = np.unique(self.hashes(self.length, self.alive), return_inverse=True, return_counts=True)
        return found, place, count


def marks_of(answers: pa.Table, level: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The answered bit of each sorted distinct hash; buckets without an answer have no marks."""
    marks = np.zeros(len(hashes), dtype=bool)
    edges = bucket_edges(hashes, buckets)
    own = answers.filter(pc.equal(answers["level"], level))
    for bucket, packed in zip(own["bucket"].to_pylist(), own["marks"].to_pylist()):
        lo, hi = edges[bucket], edges[bucket + 1]
        marks[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo).astype(bool)
    return marks


def replay(rows: pa.Table, answers: pa.Table, lengths: list[int], buckets: int) -> Windows:
    """The windows still live before the last of ``lengths`` is decided."""
    windows = Windows(rows)
    windows.start(lengths[0])
    for level, length in enumerate(lengths[1:]):
        found, place, count = windows.distinct()
        repeated = marks_of(answers, level, found, buckets) | (count > 1)
        windows.narrow(length, repeated[place])
    return windows


def owners(windows: Windows, place: np.ndarray, size: int) -> np.ndarray:
    """Smallest document of the block that holds each hash."""
    smallest = np.full(size, LAST_ID, dtype=np.int64)
    np.minimum.at(smallest, place, windows.ids[windows.rows[windows.alive]])
    return smallest


def ask(block: int, windows: Windows, buckets: int, final: bool) -> pa.Table:
    """One row per bucket with the block's distinct hashes: 32 bits while narrowing, 96 bits and owners for the decision."""
    found, place, _ = windows.distinct()
    edges = bucket_edges(found, buckets)
    used = np.flatnonzero(np.diff(edges))
    short = scaled(found, buckets).astype(np.uint32)
    if final:
        first = np.zeros(len(found), dtype=np.int64)
        first[place] = np.arange(len(place))
        second = windows.hashes(windows.length, windows.alive[first], lane=1).astype(np.uint32)
        smallest = owners(windows, place, len(found))
    hashes, more, ids = [], [], []
    for lo, hi in zip(edges[used], edges[used + 1]):
        if final:
            hashes.append(found[lo:hi].tobytes())
            more.append(second[lo:hi].tobytes())
            ids.append(squeezed(smallest[lo:hi]))
        else:
            # Sorted values lie close together, so the high bytes of their differences are mostly zero.
            steps = np.diff(short[lo:hi], prepend=np.uint32(0))
            hashes.append(squeezed(steps.view(np.uint8).reshape(-1, 4).T))
            more.append(None)
            ids.append(None)
    columns = {"bucket": used, "block": np.full(len(used), block), "size": np.diff(edges)[used], "hashes": hashes, "more": more, "owners": ids}
    schema = arrow_schema(QUESTIONS)
    return pa.table({field.name: pa.array(columns[field.name], field.type) for field in schema}, schema)


def repeats_elsewhere(level: int):
    """For each block of a bucket: which of its hashes another block has too."""

    def run(rows: pa.Table) -> pa.Table:
        lists = []
        for packed, size in zip(rows["hashes"].to_pylist(), rows["size"].to_pylist()):
            steps = np.ascontiguousarray(spread(packed, np.uint32, size).view(np.uint8).reshape(4, -1).T)
            lists.append(np.cumsum(steps.view(np.uint32).ravel(), dtype=np.uint32))
        together = np.sort(np.concatenate(lists))
        twice = np.unique(together[1:][together[1:] == together[:-1]])
        if not len(twice):
            return answer_table(rows, level, [])
        return answer_table(rows, level, [twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own for own in lists])

    return run


def earlier_elsewhere(level: int):
    """For each block of a bucket: which of its windows also start in a document with a smaller id than any of the block's."""

    def run(rows: pa.Table) -> pa.Table:
        first = [np.frombuffer(own, np.uint64) for own in rows["hashes"].to_pylist()]
        second = [np.frombuffer(own, np.uint32) for own in rows["more"].to_pylist()]
        smallest = [spread(own, np.int64, size) for own, size in zip(rows["owners"].to_pylist(), rows["size"].to_pylist())]
        sizes = [len(own) for own in first]
        keys, rest, ids = np.concatenate(first), np.concatenate(second), np.concatenate(smallest)
        order = np.lexsort((ids, rest, keys))
        keys, rest = keys[order], rest[order]
        heads = np.ones(len(keys), dtype=bool)
        heads[1:] = (keys[1:] != keys[:-1]) | (rest[1:] != rest[:-1])
        least = ids[order][heads][np.cumsum(heads) - 1]
        earlier = np.zeros(len(ids), dtype=bool)
        earlier[order] = least < ids[order]
        return answer_table(rows, level, np.split(earlier, np.cumsum(sizes)[:-1]))

    return run


def answer_table(rows: pa.Table, level: int, marks: list[np.ndarray]) -> pa.Table:
    told = [i for i, own in enumerate(marks) if own.any()]
    return pa.table(
        {
            "block": rows["block"].combine_chunks().take(pa.array(told, pa.int64())),
            "level": pa.array([level] * len(told), pa.int32()),
            "bucket": rows["bucket"].combine_chunks().take(pa.array(told, pa.int64())),
            "marks": pa.array([np.packbits(marks[i]).tobytes() for i in told], pa.binary()),
        }
    )


def decided(blocks: Blocks, window: int, shortest: int, bucket_hashes: int) -> tuple[DataFrame, list[int], int]:
    """The answers of all levels, the window lengths and the number of buckets."""
    lengths = levels(window, shortest)
    buckets = max(1, -(-blocks.text_bytes // (BYTES_PER_WORD * bucket_hashes)))
    answers = blocks.table.sparkSession.createDataFrame([], ANSWERS)
    for level, length in enumerate(lengths):
        upto, final = lengths[: level + 1], length == window

        def question(block: int, rows: pa.Table, known: pa.Table, upto: list[int] = upto, final: bool = final) -> pa.Table:
            return ask(block, replay(rows, known, upto, buckets), buckets, final)

        judge = earlier_elsewhere(level) if final else repeats_elsewhere(level)
        asked = blocks.answered(answers, question, QUESTIONS)
        answers = answers.unionByName(materialise(asked.groupBy("bucket").applyInArrow(judge, ANSWERS), "repeat-answers"))
    return answers, lengths, buckets


def covered(windows: Windows, removable: np.ndarray) -> np.ndarray:
    """Words that lie in at least one of the removable windows."""
    change = np.zeros(len(windows.starts) + 1, dtype=np.int32)
    at = windows.alive[removable]
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.length, -1)
    return np.cumsum(change[:-1]) > 0


def kept_texts(windows: Windows, removed: np.ndarray) -> list[bytes]:
    """Remaining words of each row, joined by one space."""
    row_of_kept = windows.rows[~removed]
    starts, ends = windows.starts[~removed], windows.ends[~removed]
    stops = np.minimum(ends + 1, windows.offsets[row_of_kept + 1])
    change = np.zeros(len(windows.data) + 1, dtype=np.int8)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    stays = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    clean = np.where(spans.IS_BLANK[windows.data], np.uint8(0x20), windows.data)
    edges = windows.offsets.tolist()
    return [clean[a:b][stays[a:b]].tobytes().rstrip(b" ") for a, b in zip(edges, edges[1:])]


def without_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """``docs`` (doc_id, text) with each text cut to the words that no earlier document's window covers.

    Returns doc_id, n_words, n_removed and kept_text, one row per input row. Windows are judged on the input texts.
    """
    blocks = pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    answers, lengths, buckets = decided(blocks, window, shortest, bucket_hashes)

    def cut(_: int, rows: pa.Table, known: pa.Table) -> pa.Table:
        windows = replay(rows, known, lengths, buckets)
        found, place, _ = windows.distinct()
        own = windows.ids[windows.rows[windows.alive]]
        elsewhere = marks_of(known, len(lengths) - 1, found, buckets)
        removed = covered(windows, elsewhere[place] | (owners(windows, place, len(found))[place] < own))
        count = len(windows.ids)
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "n_words": pa.array(np.bincount(windows.rows, minlength=count), pa.int64()),
                "n_removed": pa.array(np.bincount(windows.rows[removed], minlength=count), pa.int64()),
                "kept_text": pa.array(kept_texts(windows, removed), pa.binary()).cast(pa.string()),
            }
        )

    return blocks.answered(answers, cut, "doc_id long, n_words long, n_removed long, kept_text string")
