"""An FM-index over word numbers: suffix array by prefix doubling, a wavelet
matrix over the Burrows-Wheeler transform, sampled suffix positions. All steps
work on whole numpy arrays: many patterns are searched at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 32


class BitVector:
    """Bits with constant-time rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) // 64 + 1
        packed = np.zeros(n * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[:len(raw)] = raw
        self.words = packed.view("<u8").astype(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma).bit_length())
        self.levels: list[tuple[int, BitVector]] = []
        rest = symbols
        for shift in range(self.depth - 1, -1, -1):
            bits = (rest >> shift) & 1 != 0
            self.levels.append((shift, BitVector(bits)))
            rest = np.concatenate([rest[~bits], rest[bits]])

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, v in self.levels:
            ones = v.rank(at)
            at = np.where((symbol >> shift) & 1 != 0, v.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._descend(symbol, at) - self._descend(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for _, v in self.levels:
            bit, ones = v.get(at), v.rank(at)
            out = out << 1 | bit
            at = np.where(bit, v.zeros + ones, at - ones)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order. 0 separates texts: each separator is a symbol of its
    own, so no comparison runs past the end of a text."""
    n = len(symbols)
    sep = symbols == 0
    first = symbols.astype(np.int64) + int(sep.sum())
    first[sep] = np.arange(int(sep.sum()))
    width = int(first.max()) + 2
    after = np.zeros(n, np.int64)
    after[:-1] = first[1:] + 1
    key = first * width + after
    sa = np.argsort(key)
    key = key[sa]
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
    k = 2
    while len(open_):
        suf = sa[open_]
        key = rank[suf] * n + rank[np.minimum(suf + k, n - 1)]
        order = np.argsort(key, kind="stable")
        suf, key = suf[order], key[order]
        sa[open_] = suf
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        rank[suf] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~new | ~np.append(new[1:], True)]
        k *= 2
    return sa


class FMIndex:
    """Of texts given as one array of word numbers 1..sigma, each text
    followed by 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        self.n = len(symbols)
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        self.wavelet = WaveletMatrix(bwt.astype(np.uint32), sigma)
        # A text's first word is always sampled, so a walk never leaves its text.
        marked = (sa % sample == 0) | (bwt == 0)
        self.marked, self.samples = BitVector(marked), sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each pattern. Patterns are rows, filled up
        with -1 at the front; a word number 0 occurs nowhere."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        hi[(patterns == 0).any(axis=1)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            at = np.flatnonzero((lo < hi) & (patterns[:, j] > 0))
            if not len(at):
                continue
            c = patterns[at, j]
            lo[at] = self.smaller[c] + self.wavelet.rank(c, lo[at])
            hi[at] = self.smaller[c] + self.wavelet.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text place of each suffix row: walk back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.marked.get(at)
            out[left[done]] = self.samples[self.marked.rank(at[done])] + steps
            left, at = left[~done], at[~done]
            c = self.wavelet.access(at)
            at = self.smaller[c] + self.wavelet.rank(c, at)
            steps += 1
        return out
