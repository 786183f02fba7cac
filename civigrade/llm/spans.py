"""Words and word windows of whole Arrow text columns, as numpy arrays.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, so they can be
found on UTF-8 bytes. Nothing here knows Spark; the operators call it inside their Arrow tasks, on slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
BLANKS = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint8)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[BLANKS] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of the splitmix generator)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: Where the hash of a word starts, for each lane; what keeps the bytes of a word's last eight; longer words are hashed one by one.
LANES = mixed(np.array([978, 979], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LAST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 1 << 10


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every word, in order."""
    if len(data) == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~IS_BLANK[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time are mixed into all bits of what came before, so no order or structure cancels."""
    left = ends - starts
    result = mixed(left.astype(np.uint64) + LANES[lane])
    long = np.flatnonzero(left > LONG_WORD)
    for i in long.tolist():
        result[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(LANES[lane]))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    open_words = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, left = starts[open_words], left[open_words]
    while len(open_words):
        result[open_words] = mixed(result[open_words] ^ (eights[at] & LAST_BYTES[np.minimum(left, 8)]))
        more = left > 8
        open_words, at, left = open_words[more], at[more] + 8, left[more] - 8
    return result


def window_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """A hash of each run of ``count`` consecutive entries (also of runs across rows; see ``windows_inside``)."""
    size = len(hashes) - count + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    result = hashes[:size].copy()
    for step in range(1, count):
        result ^= result >> np.uint64(29)
        result *= np.uint64(0x9FB21C651E98DF25)
        result += hashes[step : step + size]
    return mixed(result)


def windows_inside(rows: np.ndarray, count: int) -> np.ndarray:
    """Whether the window that starts at each word (where one of ``count`` words can start) stays inside its row."""
    size = len(rows) - count + 1
    return rows[: max(size, 0)] == rows[count - 1 :] if size > 0 else np.zeros(0, dtype=bool)
