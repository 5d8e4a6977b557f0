"""Vectorised helpers over the UTF-8 bytes of an Arrow batch of texts.

A batch is cut into blocks of whole documents of about BLOCK bytes (a longer document is
a block of its own), so that the numpy work arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONSPACE = np.ones(256, bool)
_NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK * 2)
        for i, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def running_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a sequence of uint64, for Block.span_hash()."""
    power, _ = _power_tables(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len(col) + 1) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    dtype = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, dtype)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Block:
    """Some whole documents: `first` is the first one's row in the batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix_hash(self, data: np.ndarray | None = None) -> np.ndarray:
        """Running polynomial hash; span_hash() cuts any span's hash out of it."""
        return running_hash(_BYTE[self.data if data is None else data])

    def span_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _power_tables(len(prefix))
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))

    def run_hash(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """span_hash() of the run of `length` bytes from each position that has so many."""
        n = max(0, len(prefix) - length)
        _, inverse = _power_tables(len(prefix))
        return mix((prefix[length : length + n] - prefix[:n]) * inverse[:n] + np.uint64(length))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes other than ASCII white space."""
        flag = _NONSPACE[self.data]
        if not len(flag):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = np.zeros(len(flag) + 1, bool)
        bound[self.offsets] = True
        first = flag.copy()
        first[1:] &= ~flag[:-1] | bound[1:-1]
        last = flag.copy()
        last[:-1] &= ~flag[1:] | bound[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def count_in(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted positions each document holds."""
        return np.diff(np.searchsorted(positions, self.offsets))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.count_in(positions))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value a byte over each document."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[self.offsets])


def blocks(col: pa.Array, lower: bool = False, most: int = BLOCK) -> Iterator[Block]:
    data, offsets = utf8_buffers(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        part = data[offsets[i] : offsets[j]]
        yield Block(i, _LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])
        i = j


def window_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (len(word_hash) - n + 1 of them)."""
    m = max(0, len(word_hash) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word_hash[k : k + m]
    return mix(out)


def segment_reduce(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduceat over consecutive runs of the given lengths, `empty` for empty runs."""
    out = np.full((len(counts), *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        out[full] = ufunc.reduceat(values, starts[full], axis=0)
    return out
