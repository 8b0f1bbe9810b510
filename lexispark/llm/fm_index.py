"""A word-level FM-index over short segments: suffix array, wavelet matrix, backward search, sampled locate.

The indexed text is a list of segments of symbols 1..V, each closed by a separator. Separators are ordered by position, so a suffix is
compared up to the end of its segment at most and the suffix order is a full one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes of `text` (0 separates). As many symbols as fit 62 bits make the first key; then the known prefix doubles on unsettled groups only."""
    n, k = len(text), max(1, 62 // bits)
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(k):
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - j)] = text[j:]
        key = (key << bits) | np.where(alive, ahead, 0)
        alive &= ahead > 0
    sa = np.argsort(key, kind="stable")
    key, open_ = key[sa], alive[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | ~open_[1:]
    rank = np.empty(n, dtype=np.int64)
    while True:
        first = np.flatnonzero(new)
        start = np.repeat(first, np.diff(np.append(first, n)))
        rank[sa] = start
        rows = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(rows):
            return sa
        at = sa[rows]
        group, ahead = start[rows], rank[at + k]
        order = np.lexsort((ahead, group))
        sa[rows] = at[order]
        ahead = ahead[order]
        new[rows[1:]] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        k *= 2


class Bits:
    """A bit vector with rank: counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.append(bits, np.zeros(64 - n % 64, dtype=bits.dtype)), bitorder="little").view(np.uint64)
        self.words, self.n = packed, n
        self.before = np.zeros(len(packed) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: symbol and rank queries over a sequence, a bit vector a level."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before place i (both arrays)."""
        lo, hi = np.zeros_like(i), i
        for level, (v, z) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            lo1, hi1 = v.rank(lo), v.rank(hi)
            lo, hi = np.where(one, z + lo1, lo - lo1), np.where(one, z + hi1, hi - hi1)
        return hi - lo

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for v, z in zip(self.levels, self.zeros, strict=True):
            one = v.get(i).astype(bool)
            out = (out << 1) | one
            r = v.rank(i)
            i = np.where(one, z + r, i - r)
        return out


class FMIndex:
    """Index of one shard. `text`: symbols 1..V in segments, each followed by a 0, and nothing else."""

    def __init__(self, text: np.ndarray, symbols: int):
        bits = max(1, int(symbols).bit_length())
        sa = suffix_array(text, bits)
        self.wavelet = Wavelet(np.where(sa > 0, text[sa - 1], 0), bits)
        self.count = np.zeros(symbols + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=symbols + 1), out=self.count[1:])
        place = np.arange(len(text))
        begin = np.maximum.accumulate(np.where(np.append(True, text[:-1] == 0), place, 0))
        kept = (place - begin) % SAMPLE == 0  # a segment's first place always, so that no walk crosses a separator
        self.sampled = Bits(kept[sa])
        self.positions = sa[kept[sa]]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of equal length, symbols 1..V)."""
        c = patterns[:, -1]
        lo, hi = self.count[c].copy(), self.count[c + 1].copy()
        live = np.flatnonzero(lo < hi)
        for j in range(patterns.shape[1] - 2, -1, -1):
            if not len(live):
                break
            c = patterns[live, j]
            lo[live] = self.count[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.count[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: walk back to a sampled one."""
        out, steps, row = np.empty(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), rows.copy()
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled.get(row[left]).astype(bool)
            done = left[hit]
            out[done] = self.positions[self.sampled.rank(row[done])] + steps[done]
            left = left[~hit]
            c = self.wavelet.get(row[left])
            row[left] = self.count[c] + self.wavelet.rank(c, row[left])
            steps[left] += 1
        return out
