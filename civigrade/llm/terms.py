"""Exact vocabularies of Arrow text columns: which bytes make a word or term, and the distinct ones of a slice.

Arrow's dictionary compares the bytes themselves, so two words have the same code only if they are equal. Nothing here knows Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of terms: ASCII digits and letters, and all of every other character.
IN_TERM = np.zeros(256, dtype=bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IN_TERM[_first : _last + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every maximal run of bytes ``inside``; runs end with their row."""
    if len(inside) == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` (under 2 GB, as every Spark text) as an Arrow column."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encoded(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for every run of bytes ``inside``, and the distinct runs by code."""
    found = binary_array(data[inside], ends - starts).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def split_terms(blobs: list[bytes]) -> pa.Array:
    """The terms of blobs in which they are joined by one blank, blob after blob."""
    data = np.frombuffer(b" ".join(b for b in blobs if b), dtype=np.uint8)
    blank = data == 0x20
    edges = np.concatenate([[-1], np.flatnonzero(blank), [len(data)]])
    lengths = np.diff(edges) - 1
    return binary_array(data[~blank], lengths) if len(data) else pa.array([], pa.binary())
