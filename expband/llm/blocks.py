"""Texts of Arrow batches as numpy arrays: words, their hashes, distinct values per row.

Word positions are byte offsets into the joined UTF-8 bytes of a slice of rows. All hashes are
64-bit, the same in every process, and mixed so that any bits of them can be used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time.
SLICE_BYTES = 1 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit numbers that depend on the salt alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(1 + salt * 1_000_003)) * GOLDEN)


BYTE_VALUE = seeds(256, 7)
BASE = np.uint64(0xD6E8FEB86659FD93)


def byte_table(members: str) -> np.ndarray:
    """A 256-entry mask of the given ASCII characters."""
    out = np.zeros(256, dtype=bool)
    out[list(members.encode("ascii"))] = True
    return out


#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = byte_table(" \t\n\v\f\r")
#: The same bytes, A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a string column and the rows + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice of texts.

    start, end: byte positions of each word; first: index of each row's first word, and the number
    of words; row: each word's row.
    """

    def __init__(self, column: pa.Array, lower: bool = False, breaks: np.ndarray = WHITE):
        self.raw, self.offsets = text_bytes(column)
        if lower:
            self.raw = LOWER[self.raw]
        inside = ~breaks[self.raw]
        fresh = np.zeros(len(inside) + 1, dtype=bool)
        fresh[self.offsets] = True
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        self.start = np.flatnonzero(inside & (~before | fresh[:-1]))
        self.end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes and length."""
        if not len(self):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        at = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(int(length.sum())) - np.repeat(at, length)
        powers = np.full(int(length.max()), BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        if self._inside is None:
            inner = self.raw[np.repeat(self.start, length) + place]
        else:
            inner = self.raw[self._inside]
        value = BYTE_VALUE[inner] * powers[place]
        return mix(np.add.reduceat(value, at) + length.astype(np.uint64) * GOLDEN)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``size`` words that stay inside a row, and their hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.diff(first)
    room = np.repeat(first[1:], left) - np.arange(n)
    starts = np.flatnonzero(room >= size)
    # By doubling: the hash over 2L words combines those over L words, as long as that fits.
    span, level = 1, hashes
    total, done = np.zeros(len(starts), np.uint64), 0
    while True:
        if size & span:
            total = mix(total * BASE + level[starts + done] + GOLDEN)
            done += span
        if done == size:
            return starts, total
        level = mix(level * BASE + np.concatenate((level[span:], np.zeros(min(span, n), np.uint64)))
                    + np.uint64(span))
        span *= 2


def distinct_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, joined, and the rows + 1 offsets."""
    if not len(values):
        return values, np.zeros(rows + 1, np.int64)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=rows))))


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)
