"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is a set of word shingles; a document is contaminated if it holds a given share of an item's shingles. MinHash compares sets
by their Jaccard similarity, which containment in a long document makes vanishingly small. So items are partitioned by the size of
their set, and for each partition documents are looked at through windows of about that size: for items of up to ``2**k`` shingles
three neighbouring runs of ``2**(k - 1)``, one beginning at every run. An item that lies in a document lies in one of the windows.
There its Jaccard similarity is at least 0.25 at a containment of 0.8 (for the smallest items of a partition; 0.47 for the largest)
and 0.33 at full containment. Sketches are the least value of each of ``PERMUTATIONS`` hash functions; each is a band of its own, so
a window and an item become a candidate pair if any of them agrees, which fails once in 100,000 at 0.25 (0.75 ** 40) and once in ten
million at 0.33. Candidates are verified by the exact share of the item's shingles in the whole document, compared as words.

The documents never move: their sketches are made and looked up in the scan, and every shingle is touched once for each hash function;
the least values of a longer run are those of its halves. Items are sketched in tasks of their own. The sketches are broadcast in
chunks meant for ``CHUNK_BYTES`` of text, dealt by hash; with several chunks the documents are scanned once for each, and a chunk's
result is written before the next chunk is sent, so no more than one is held.

Words are maximal runs without ASCII white space, compared in lower case (A-Z). Defined results: null and empty texts have no
shingles, and a document or item without any takes part in no pair; a text with fewer words than a shingle is one shingle of all of
them; repeated items and repeated documents give a pair each; item ids may be null and are returned so; further columns stay as they
are, but for one that has the name of the added column, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civigrade.llm import spans
from civigrade.llm.blocks import unused
from civigrade.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS = 40
_SEEDS = spans.mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
SHIFTS, FACTORS = _SEEDS[:PERMUTATIONS], _SEEDS[PERMUTATIONS:] | np.uint64(1)
#: Runs of a window; all but one hold the items of a partition.
RUNS = 3
CHUNK_BYTES = 16 << 20
SKETCHES = "item_id long, n_shingles long, least binary, shingles binary, n_bytes long"
FOUND = "array<struct<item_id:bigint,n_shingles:int,n_shared:int>>"


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)


def shingle_hashes(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, in order; rows with fewer words than ``size`` have one shingle of all their words."""
    starts, ends, rows = spans.words(offsets, data)
    hashes = spans.word_hashes(data, starts, ends)
    inside = np.flatnonzero(spans.windows_inside(rows, size))
    found, of_row = spans.window_hashes(hashes, size)[inside], rows[inside]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        whole = np.array([spans.window_hashes(hashes[a : a + counts[r]], int(counts[r]))[0] for a, r in zip(first, short)], dtype=np.uint64)
        found, of_row = np.concatenate([found, whole]), np.concatenate([of_row, short])
        order = np.argsort(of_row, kind="stable")
        found, of_row = found[order], of_row[order]
    return found, of_row


def shingle_words(text: str | None, size: int) -> set[bytes]:
    """The exact shingles of a text: its words in lower case, joined by one blank."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def sketched(items: DataFrame, size: int) -> DataFrame:
    """Least values and exact shingles (one a line) of every item that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.sliced(batches, "text"):
            offsets, data = spans.buffers(batch.column("text"))
            hashes, rows = shingle_hashes(offsets, ascii_lower(data), size)
            heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))[: len(rows)]
            least = np.stack([np.minimum.reduceat((hashes ^ s) * f, heads) for s, f in zip(SHIFTS, FACTORS)], axis=1) if len(rows) else np.zeros((0, PERMUTATIONS), np.uint64)
            found = [shingle_words(batch.column("text")[row].as_py(), size) for row in rows[heads].tolist()]
            columns = {
                "item_id": batch.column("item_id").take(pa.array(rows[heads])), "n_shingles": pa.array([len(own) for own in found], pa.int64()),
                "least": pa.array([row.tobytes() for row in least], pa.binary()), "shingles": pa.array([b"\n".join(own) for own in found], pa.binary()),
                "n_bytes": pa.array(np.diff(offsets)[rows[heads]]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    return materialise(texts.mapInArrow(run, SKETCHES).withColumn("number", F.monotonically_increasing_id()), "item-sketches")


def seen(values: np.ndarray) -> np.ndarray:
    """Flags by the lowest bits of the values: what has none of them need not be searched for."""
    flags = np.zeros(1 << (16 * len(values)).bit_length(), dtype=bool)
    flags[values & np.uint64(len(flags) - 1)] = True
    return flags


class ItemIndex:
    """Sketches and exact shingles of a chunk of items, by size partition."""

    def __init__(self, items: list, size: int):
        self.size, self.ids = size, [item["item_id"] for item in items]
        self.shingles = [frozenset(bytes(item["shingles"]).split(b"\n")) for item in items]
        least = np.array([np.frombuffer(item["least"], np.uint64) for item in items]).reshape(-1, PERMUTATIONS)
        #: Exponents of the run lengths, rising; for each of them and each hash function the sorted least values and their items.
        classes = np.array([max((item["n_shingles"] - 1).bit_length() - 1, 0) for item in items], dtype=np.int64)
        self.exponents = np.unique(classes).tolist()
        self.bands = []
        for exponent in self.exponents:
            members = np.flatnonzero(classes == exponent)
            order = np.argsort(least[members], axis=0, kind="stable")
            self.bands.append([(least[members[o], number], members[o], seen(least[members, number])) for number, o in enumerate(order.T)])

    def candidates(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Distinct pairs (row, item) of which some window of the row agrees with the item in one of the bands."""
        hashes, rows = shingle_hashes(offsets, data, self.size)
        if not len(hashes):
            return np.zeros((0, 2), dtype=np.int64)
        levels, place, before = [], np.arange(len(rows)) - np.searchsorted(rows, rows), 0
        for exponent in self.exponents:
            heads = np.flatnonzero(place % (1 << (exponent - before)) == 0)
            rows, place, before = rows[heads], place[heads] >> (exponent - before), exponent
            levels.append((heads, rows, [rows[step:] == rows[:-step] for step in range(1, RUNS)]))
        pairs = []
        for number in range(PERMUTATIONS):
            values = (hashes ^ SHIFTS[number]) * FACTORS[number]
            for (heads, of_run, same), bands in zip(levels, self.bands):
                values = np.minimum.reduceat(values, heads)
                joined = values.copy()
                for step, inside in enumerate(same, 1):
                    np.minimum(joined[:-step], values[step:], out=joined[:-step], where=inside)
                keys, members, flags = bands[number]
                able = np.flatnonzero(flags[joined & np.uint64(len(flags) - 1)])
                low = np.minimum(np.searchsorted(keys, joined[able]), len(keys) - 1)
                hits = np.flatnonzero(keys[low] == joined[able])
                for run, first in zip(able[hits].tolist(), low[hits].tolist()):
                    own = members[first : np.searchsorted(keys, joined[run], "right")]
                    pairs.append(np.stack([np.full(len(own), of_run[run]), own], axis=1))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)

    def shared(self, text: str, numbers: list[int], threshold: float) -> list[dict]:
        """Items of ``numbers`` that the whole text contains to the threshold, with exact counts."""
        own, found = shingle_words(text, self.size), []
        for number in numbers:
            common = len(self.shingles[number] & own)
            if common >= threshold * len(self.shingles[number]):
                found.append({"item_id": self.ids[number], "n_shingles": len(self.shingles[number]), "n_shared": common})
        return found


def indexes(items: DataFrame, size: int, chunk_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items' indexes and whether there is only one; of several, each is taken back when the next is asked for."""
    sketches = sketched(items, size)
    total = sketches.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_bytes))
    for chunk in range(chunks):
        own = sketches.filter(F.pmod(F.xxhash64("number"), F.lit(chunks)) == chunk).drop("number", "n_bytes").collect()
        if own:
            index = items.sparkSession.sparkContext.broadcast(ItemIndex(own, size))
            yield index, chunks == 1
            if chunks > 1:
                index.destroy()


def matched(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, name: str = "matches", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``name``: the items that each whole text contains, as a list of (item_id, n_shingles, n_shared)."""
    result = docs.drop(name).withColumn(name, F.array().cast(FOUND))
    for index, alone in indexes(items, size, chunk_bytes):
        result = matched_chunk(result, index, threshold, name)
        if not alone:
            result = materialise(result, "matches")
    return result


def matched_chunk(docs: DataFrame, index: Broadcast, threshold: float, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the matches of one chunk added to those they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in spans.sliced(batches, text):
            offsets, data = spans.buffers(batch.column(text))
            numbers: dict[int, list[int]] = {}
            for row, item in items.candidates(offsets, ascii_lower(data)).tolist():
                numbers.setdefault(row, []).append(item)
            if numbers:
                place = batch.schema.get_field_index(name)
                lists = batch.column(place).to_pylist()
                for row, own in numbers.items():
                    lists[row] = lists[row] + items.shared(batch.column(text)[row].as_py(), own, threshold)
                batch = batch.set_column(place, batch.schema.field(place), pa.array(lists, batch.schema.field(place).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def contaminated_pairs(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, n_shingles, n_shared, containment."""
    rows = matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, size, threshold, chunk_bytes=chunk_bytes)
    found = rows.select("doc_id", F.inline("matches"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents that contain no item."""
    name = unused(docs, "matches")
    return matched(docs, items, size, threshold, name, chunk_bytes).filter(F.size(name) == 0).drop(name)
