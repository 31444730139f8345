"""Words of Arrow text columns as flat NumPy arrays, for use inside tasks.

A column is cut into slices of whole documents of about ``SLICE`` bytes and at most ``SLICE_ROWS`` rows, so that the arrays of
one step stay small whatever the batch; a longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
SLICE_ROWS = 1 << 15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between blanks: all but space and \t \n \v \f \r.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of terms: digits, lower-case letters, and every byte of a character beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[97:123] = TERM[128:] = True

_RANDOM = np.random.default_rng(20240607)
_VALUE = _RANDOM.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_COEFFICIENT = _RANDOM.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


class Slice(NamedTuple):
    first: int  # row of the batch
    last: int
    data: np.ndarray  # bytes of the rows, one after the other
    offsets: np.ndarray  # where each row starts, and the end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    data, offsets = flat(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), first + SLICE_ROWS, rows)
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of its first word (and the total)."""
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of the value."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.insert(0 if base == _BASE else 1, np.multiply.accumulate(p))
        del _powers[2:]
    return _powers


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from one running sum over the bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive values (fewer values give none)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _COEFFICIENT[0]
    for k in range(1, length):
        total += h[k : k + n] * _COEFFICIENT[k]
    return mixed(total)
