"""Vectorised word kernels shared by the operators of this subpackage.

A column of texts is laid out as one byte buffer with a zero byte before and after each text, so that no word crosses two texts.
Words are found and hashed with numpy passes over that buffer; no Python object is made per word. Chunks hold about
`CHUNK_BYTES` of text (a longer text is a chunk of its own), which bounds the memory whatever the Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased UTF-8: digits, a-z and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_powers = {"n": 0, "up": None, "down": None}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, modulo 2**64; kept for the next call while n is of a usual size."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        both = []
        for base in (BASE, INVERSE):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            both.append(out)
        if size > 4 * CHUNK_BYTES:
            return both[0], both[1]
        _powers.update(n=size, up=both[0], down=both[1])
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def layout(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunked(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of rows lo..hi: byte ranges `s`, `e` in `buf` (lower-cased), 64-bit `hash`, first word of each row in `first`."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int, mask: np.ndarray = WORD):
        n = hi - lo
        raw = np.zeros(int(offs[hi] - offs[lo]) + n + 1, dtype=np.uint8)
        self.at = np.empty(n + 1, dtype=np.int64)
        to = 1
        for i in range(lo, hi):
            a, b = int(offs[i]), int(offs[i + 1])
            self.at[i - lo] = to
            raw[to : to + b - a] = data[a:b]
            to += b - a + 1
        self.at[n] = to
        self.raw = raw
        self.buf = LOWER[raw]
        inside = mask[self.buf]
        inside[self.at - 1] = False
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.s, self.e = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.s, self.at)
        self.n = n

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.buf) + 1)
        total = np.empty(len(self.buf) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=total[1:])
        return mix((total[self.e] - total[self.s]) * down[self.s])

    def row(self) -> np.ndarray:
        """Row of each word, counted from lo."""
        return np.repeat(np.arange(self.n), np.diff(self.first))


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring words; the last k-1 places stay out."""
    if len(h) < k:
        return h[:0]
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(BASE) + h[j : len(h) - k + 1 + j]
    return mix(out)


def points(buf: np.ndarray) -> np.ndarray:
    """Number of code points before each byte of a UTF-8 buffer, one entry more than bytes."""
    out = np.empty(len(buf) + 1, dtype=np.int64)
    out[0] = 0
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out
