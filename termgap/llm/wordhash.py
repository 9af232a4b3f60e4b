"""Words of Arrow text columns as 64-bit hashes, and hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 1 << 21
_rng = np.random.default_rng(20240229)
#: One random odd multiplier for each byte value and for each power; fixed by the seed, so alike in every task.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: For matching regardless of punctuation: every ASCII byte but letters and digits parts words.
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Fixed finalizer (xor-shift and multiply) that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column):
    """(first row, rows, bytes, row offsets) of consecutive rows, about SLICE_BYTES or one row at a time."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(len(column), max(at + 1, end))
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of a slice, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~blank[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a word ends with its row
    open_ = solid.copy()
    open_[1:] &= ~solid[:-1] | first[1:n]
    close = solid.copy()
    close[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on, as far as so many follow; rows are not looked at."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mixed((total[size:] - total[: n - size + 1]) * down[: n - size + 1] + np.uint64(size))
