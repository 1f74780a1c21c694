"""Words of whole Arrow text columns as 64-bit hashes, with numpy and without a Python object for each word.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums over the batch and then mixed. Two different words, windows or shingles agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are worked on at once; a longer document is taken by itself.
SLICE = 1 << 21
_rng = np.random.default_rng(20240607)
_MIX = _rng.integers(0, 2**64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Factors of a shingle's or window's words by their place.
PLACES = _rng.integers(0, 2**64, 64, dtype=U) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM_WORDS = np.ones(256, bool)
ALNUM_WORDS[0x00:0x30] = ALNUM_WORDS[0x3A:0x61] = ALNUM_WORDS[0x7B:0x80] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches each output bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class _Powers:
    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            n = max(n, SLICE + 1)
            up, down = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
            up[0] = down[0] = 1
            self.up, self.down, self.n = np.cumprod(up), np.cumprod(down), n
        return self.up, self.down


_powers = _Powers()


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """data: bytes of texts one after the other; offsets: where each begins, and the end. Returns the hash of each word, and where each text's words begin."""
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(offsets), np.int64)
    data = LOWER[data] if lower else data
    inside = letters[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers.upto(n + 1)
    sums = np.zeros(n + 1, U)
    part = _MIX[data]
    part *= up[:n]
    np.cumsum(part, out=sums[1:])
    h = sums[ends]
    h -= sums[begins]
    h *= down[begins]
    h += (ends - begins).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(h), np.searchsorted(begins, offsets)


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a text column into runs of rows: first row, end row, bytes, offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` consecutive words."""
    if len(h) < size:
        return np.empty(0, U)
    out = h[: len(h) - size + 1] * PLACES[0]
    for i in range(1, size):
        out += h[i : len(h) - size + 1 + i] * PLACES[i]
    return mix(out)


def whole(h: np.ndarray) -> np.uint64:
    """A hash of a sequence of under 64 words."""
    last = U(len(h) * 0xA0761D6478BD642F % 2**64)
    return mix(np.append(h * PLACES[: len(h)], last).sum(keepdims=True))[0]
