"""Texts of an Arrow batch as byte arrays: slicing by size, words, hashes. Used inside tasks only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # work of one numpy pass; a longer text is a slice of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.RandomState(20240229)
BYTE_VALUE = _rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ORDER_VALUE = _rng.randint(0, 1 << 62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins and ends; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, dtype=np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_BYTES of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(low, high - low)


class Words:
    """Words of a slice: ``start``/``end`` byte positions, ``doc`` row of each word, ``hash`` 64 bits of its bytes.

    ``first[i] : first[i + 1]`` are the words of row i.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, member: np.ndarray):
        inside = member[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = ends[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, ends)
        self.doc = np.repeat(np.arange(len(ends) - 1), np.diff(self.first))
        length = self.end - self.start
        if len(length) == 0:
            self.hash = np.empty(0, dtype=np.uint64)
            return
        base = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(base[-1] + length[-1]) - np.repeat(base, length)
        value = BYTE_VALUE[data[inside]] * powers(int(length.max()))[place]
        self.hash = mix(np.add.reduceat(value, base) ^ (length.astype(np.uint64) * STEP))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after the other."""
    total = int(lengths.sum())
    base = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(base - starts, lengths)


def binary_column(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of a flat array as a binary column; ``ends`` counts items."""
    size = flat.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(ends) - 1,
        [None, pa.py_buffer((ends.astype(np.int64) * size).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())],
    ).cast(pa.binary())
