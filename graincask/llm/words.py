"""Word and window hashes of many texts at once, over the bytes of an Arrow string column, with numpy.

A word's hash is a sum of random byte values times powers of an odd number modulo 2^64, normalised by its place and mixed;
a window's hash is the same construction over word hashes. Cost: a few vectorised passes over the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Bytes of text handled at once; a longer text is handled alone, as a whole.
CHUNK = 1 << 20


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, _inverse(base), 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.n:
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    a = np.full(n, b, U)
                    a[0] = 1
                    setattr(self, name, np.cumprod(a, dtype=U))
            self.n = n


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; low and high bits may be used as buckets after it."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


class Splitter:
    """Splits texts into words: maximal runs of bytes that aren't separators, A-Z lower-cased where asked for."""

    def __init__(self, separators: bytes, lower: bool = False):
        values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
        if lower:
            values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        self.value, self.word_byte = values, np.ones(256, bool)
        self.word_byte[list(separators)] = False
        self.value[~self.word_byte] = 0
        self.powers, self.window_powers = Powers(_P), Powers(_Q)

    def words(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends (bytes in data), hashes of the words, and for each text the number of words before it (one more entry)."""
        inside = self.word_byte[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        edge = offsets[:-1][offsets[:-1] < len(data)]
        fresh = before[:-1].copy()
        fresh[edge] = False  # a text starts: no word goes on
        starts = np.flatnonzero(inside & ~fresh)
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        cut = after[1:].copy()
        cut[edge[edge > 0] - 1] = False
        ends = np.flatnonzero(inside & ~cut) + 1
        firsts = np.searchsorted(starts, offsets)
        return starts, ends, self.hashes(data, starts) if hashed else np.empty(0, U), firsts

    def hashes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hashes of the words that start at given bytes and end at the next separator or start."""
        if not len(starts):
            return np.empty(0, U)
        self.powers.grow(len(data) + 1)
        values = self.value[data]
        values *= self.powers.up[: len(data)]
        # separators are 0, so a word's sum may run on to the next word
        return mix(np.add.reduceat(values, starts) * self.powers.down[starts])

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of the window of so many words that starts at each word; the last size - 1 are left out. Texts aren't told apart."""
        n = len(hashes)
        if n < size:
            return np.empty(0, U)
        self.window_powers.grow(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(hashes * self.window_powers.up[:n], out=sums[1:])
        return mix((sums[size:] - sums[: n - size + 1]) * self.window_powers.down[: n - size + 1])


def valid_windows(firsts: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that lie within one text, over all words; firsts: words before each text, and in all."""
    n = int(firsts[-1])
    ok = np.ones(n, bool)
    # the last size - 1 words of each text start none: a word is one if fewer than size words are left in its text
    lengths = np.diff(firsts)
    left = np.repeat(firsts[1:], lengths) - np.arange(n)
    ok &= left >= size
    return np.flatnonzero(ok)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Gives freed memory back to the system: idle Python workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about so many bytes of text: first row, row after the last, bytes, offsets from 0."""
    data, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    trim()


WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but digits and letters.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
