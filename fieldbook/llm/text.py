"""Words and shingles of Arrow text columns as flat numpy arrays, without a Python object per word.

A batch is cut into slices of half a megabyte (a longer text is a slice of its own), so that a task needs the same
memory whatever the batch size. A word is a run of bytes other than space and the control characters 9 to 13; only A-Z
are lower-cased, which is safe on the bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U64 = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUE = np.random.RandomState(20).randint(1, 2**62, size=256, dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)
_BYTE_VALUE[~_IS_WORD] = 0
_BASE = _U64(0x9E3779B97F4A7C15)
_STEPS = np.random.RandomState(21).randint(1, 2**62, size=64, dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)
_powers = np.ones(1, dtype=_U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x ^= x >> _U64(27)
    x *= _U64(0x81DADEF4BC2DD44D)
    x ^= x >> _U64(33)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 2 * len(_powers), 4096), _BASE, dtype=_U64)
        base[0] = 1
        _powers = np.cumprod(base, dtype=_U64)
    return _powers


@dataclass
class Words:
    """Words of a few consecutive rows. ``bounds[i]:bounds[i+1]`` are the words of row i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them); a null text has no bytes."""
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, dtype=np.uint8) if content is not None and content.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each row."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none, np.zeros(0, dtype=_U64), np.zeros(rows + 1, dtype=np.int64))
    inside = _IS_WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    hashes = np.zeros(len(starts), dtype=_U64)
    if hashed and len(starts):
        first = int(starts[0])
        spans = np.diff(np.append(starts, n))
        place = np.arange(n - first, dtype=np.int64)
        place -= np.repeat(starts - first, spans)
        value = _BYTE_VALUE[LOWER[data[first:]]]
        value *= powers(int(spans.max()) + 1)[place]
        hashes = mix(np.add.reduceat(value, starts - first) + (ends - starts).astype(_U64) * _STEPS[40])
    return Words(data, offsets, starts, ends, hashes, bounds)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, row after row, and the offsets of the rows; a row with fewer words has one."""
    h, bounds, counts = words.hashes, words.bounds, words.counts
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=_U64), np.zeros(len(bounds), dtype=np.int64)
    run = np.zeros(n, dtype=_U64)
    for j in range(min(size, n)):
        run[: n - j] += h[j:] * _STEPS[j]
    taken = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    keep = np.zeros(n + 1, dtype=np.int8)
    some = counts > 0
    np.add.at(keep, bounds[:-1][some], 1)
    np.add.at(keep, (bounds[:-1] + taken)[some], -1)
    for short in range(1, size):
        at = bounds[:-1][counts == short]
        run[at] = sum((h[at + j] * _STEPS[j] for j in range(short)), np.full(len(at), short, dtype=_U64) * _STEPS[41])
    kept = run[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    return mix(kept), np.concatenate([[0], np.cumsum(taken)])


def distinct_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their offsets."""
    if len(values) == 0:
        return values, offsets
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][offsets[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[offsets]
