"""Vectorised words and window fingerprints over Arrow string columns (NumPy only, no Spark).

A batch of texts stays one byte buffer with offsets. Word boundaries, word hashes and rolling
window hashes are whole-array operations; no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: [\x20\x09-\x0D] parts words
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_BLOCK = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_ROLL2 = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=8)
def _byte_table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        up[0] = 1
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _power_slices(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (int(n) - 1).bit_length())
    up, down = _powers(int(base), size)
    return up[:n], down[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):  # no chunks at all
            column = pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words each text has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here, so no word runs across
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if lower)."""
    table, n = _byte_table(lower), len(start)
    out = np.empty(n, np.uint64)
    i = 0
    while i < n:
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, lo + _BLOCK, side="right")))
        hi = int(end[j - 1])
        up, down = _power_slices(_STEP, hi - lo + 1)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of n hashes; windows across texts are for the caller to leave out."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_slices(_ROLL2 if second else _ROLL, len(hashes) + 1)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum((mix(hashes + _STEP) if second else hashes) * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:count] + np.uint64(n))


def trim() -> None:
    """Gives freed memory back to the system: workers are kept between tasks, and with them what their allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel over batches that trims when its task is done."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            trim()

    return run


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """Cuts a batch into runs of rows of about limit bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield i, j
        i = j
