"""Vectorised word splitting and hashing over UTF-8 buffers.

All word rules of the operators are byte rules: a byte of 0x80 or more is
always part of a word, so words of UTF-8 texts can be cut on bytes."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Word bytes of [^\x20\x09-\x0D]+ .
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = False
NOT_SPACE[0x09:0x0E] = False

#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, lower-case letters, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20250101).integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)
_BLOCK = 2 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int, block: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept for blocks of the usual size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, block), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * block:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
    """Words of the rows of a lower-cased buffer: start and end byte and row
    of each. A word never crosses a row border."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = word[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, by
    prefix sums, taken in blocks of bytes so that long texts need no more
    memory; the size of a block does not change a hash."""
    block = block or _BLOCK
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[data[a:b]] * _power(_BASE, b - a, block), out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        h = (total[e] - total[s]) * _power(_INVERSE, b - a, block)[s]
        out[lo:hi] = mix(h + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        lo = hi
    return out


def hash_word(word: bytes) -> int:
    """The hash of one word, as ``hashes`` gives it."""
    a = np.frombuffer(word, np.uint8)
    return int(hashes(a, np.array([0]), np.array([len(a)]))[0]) if len(a) else 0
