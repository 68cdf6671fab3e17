"""Words of Arrow text columns as numpy arrays: spans, rows and 64-bit hashes, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All other bytes of UTF-8 belong to words, so spans of bytes are
spans of characters. Null texts are empty. Texts are never cut; `slices` only bounds how many rows are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 1000
#: Bytes whose hashes are summed at once; one longer span is summed by itself.
HASH_BYTES = 1 << 16

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240917))
_LETTER = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(HASH_BYTES)
#: The powers are odd, so each has an inverse.
_INVERSE = _powers(HASH_BYTES, np.uint64(pow(int(_STEP), -1, 1 << 64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result may serve as a bucket."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending spans that do not overlap; empty spans hash to mix(0).

    The hash is the sum of letter * power(place in the span): the difference of two running sums over the bytes, by the inverse
    of the power where the span starts.
    """
    length = (ends - starts).astype(np.uint64)
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, low + HASH_BYTES, "left")))
        high = int(ends[upto - 1])
        powers = _POWER[: high - low] if high - low <= HASH_BYTES else _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_LETTER[data[low:high]] * powers, out=total[1:])
        first = starts[at:upto] - low
        out[at:upto] = (total[ends[at:upto] - low] - total[first]) * _INVERSE[first]
        at = upto
    return mix(out + length * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """UTF-8 bytes of some rows, end to end; row i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are no separators; a run never crosses rows."""
        word = ~separator[self.data]
        n = len(word)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:n]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> Words:
        starts, ends = self.runs(SEPARATOR)
        return Words(starts, ends, self.rows_of(starts), span_hashes(self.data, starts, ends), len(self))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words inside one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        out = np.zeros(len(first), np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD1342543DE82EF95) + self.hash[first + j]
        return first, mix(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Runs of at most `rows` rows whose texts together stay near `most` bytes; every row is in exactly one."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        upto = min(upto, at + rows)
        yield batch.slice(at, upto - at)
        at = upto
