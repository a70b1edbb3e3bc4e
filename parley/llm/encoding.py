"""Token ids of texts with a public tokenizer, one encoding per distinct piece.

A text is cut where the tokenizer always starts a new unit, and each distinct
piece is encoded once per worker and kept, up to about ``KEEP_BYTES`` of them;
pieces of more than ``LONGEST`` bytes are encoded wherever they stand. Cutting,
hashing and joining work on whole byte buffers. Pieces are looked up by a
64-bit hash and compared with the kept bytes; a piece that shares the hash of
another is encoded afresh. Tests compare the ids with those of the whole text."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from parley.llm import tokens as tk

KEEP_BYTES = 64 << 20
LONGEST = 64
CHUNK = 2 << 20
COMPARE = 1 << 18
BLOCK = 1 << 18  # bytes hashed at once

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
_SPACES = ~tk.NOT_SPACE
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x80] = True


def word_pieces(data: np.ndarray, offsets: np.ndarray):
    """For tokenizers that drop white space: any space or newline ends a unit."""
    return tk.spans(data, offsets, ~_BLANK)


def spaced_pieces(data: np.ndarray, offsets: np.ndarray):
    """For byte-level tokenizers, where a single space belongs to the word
    behind it: a unit starts at a space before a character that is no white
    space (beyond ASCII, where that is unknown, only if none stands before the
    space either). Pieces cover all bytes."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    after[:-1], before[1:] = data[1:], data[:-1]
    cut = (data == 0x20) & (_PLAIN[after] | ((after >= 0x80) & _PLAIN[before]))
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(offsets, starts, side="right") - 1


CUTS = {"word": word_pieces, "spaced": spaced_pieces}


class Encoder:
    def __init__(self, path: str, cut: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cut = CUTS[cut]
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, with the number of their piece
        self.ids_at, self.flat = np.zeros(1, np.int64), np.zeros(0, self.dtype)  # ids of the pieces and their borders
        self.text_at, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)  # bytes of the pieces and their borders

    def kept_bytes(self) -> int:
        return sum(a.nbytes for a in (self.known, self.slot, self.ids_at, self.flat, self.text_at, self.text))

    def _encoded(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for lo in range(0, len(words), 4096)
                for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[lo:lo + 4096]], add_special_tokens=False)]

    def _learn(self, new: np.ndarray, words: list[bytes]) -> None:
        """Encode words (new: their sorted hashes) and keep their ids and bytes."""
        ids = self._encoded(words)
        where = np.searchsorted(self.known, new)
        self.slot = np.insert(self.slot, where, len(self.known) + np.arange(len(new), dtype=np.int32))
        self.known = np.insert(self.known, where, new)
        self.ids_at = np.append(self.ids_at, self.ids_at[-1] + np.cumsum([len(x) for x in ids]))
        self.flat = np.concatenate([self.flat, *ids])
        self.text_at = np.append(self.text_at, self.text_at[-1] + np.cumsum([len(w) for w in words]))
        self.text = np.append(self.text, np.frombuffer(b"".join(words), np.uint8))

    def _strangers(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Places of the pieces whose bytes are not the kept ones of ``slot``."""
        at, size = self.text_at[slot], e - s
        equal = self.text_at[slot + 1] - at == size
        out, same = [np.flatnonzero(~equal)], np.flatnonzero(equal)
        ends, lo = np.cumsum(size[same]), 0
        while lo < len(same):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COMPARE, side="right")))
            k = same[lo:hi]
            n = size[k]
            stop = np.cumsum(n)
            byte = np.arange(stop[-1])
            differ = data[byte + np.repeat(s[k] - stop + n, n)] != self.text[byte + np.repeat(at[k] - stop + n, n)]
            out.append(k[np.unique(np.searchsorted(stop, np.flatnonzero(differ), side="right"))])
            lo = hi
        return np.concatenate(out)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a UTF-8 buffer, and their number in each row."""
        s, e, row = self.cut(data, offsets)
        short, long = np.flatnonzero(e - s <= LONGEST), np.flatnonzero(e - s > LONGEST)
        found, first, back = np.unique(tk.hashes(data, s[short], e[short], BLOCK), return_index=True, return_inverse=True)
        first = short[first]
        if self.kept_bytes() > KEEP_BYTES:
            self._forget()
        place = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        fresh = self.known[place] != found if len(self.known) else np.ones(len(found), bool)
        if fresh.any():
            raw = data.tobytes()
            self._learn(found[fresh], [raw[a:b] for a, b in zip(s[first[fresh]].tolist(), e[first[fresh]].tolist())])
            place = np.searchsorted(self.known, found)
        slot, flat = self.slot[place][back], self.flat
        at, size = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        at[short], size[short] = self.ids_at[slot], self.ids_at[slot + 1] - self.ids_at[slot]
        other = np.concatenate([short[self._strangers(data, s[short], e[short], slot)], long])
        if len(other):
            own = self._encoded([data[a:b].tobytes() for a, b in zip(s[other].tolist(), e[other].tolist())])
            size[other] = [len(x) for x in own]
            at[other] = len(flat) + np.cumsum(size[other]) - size[other]
            flat = np.concatenate([flat, *own])
        out = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
        return flat[out], np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of width ``dtype``."""
        raw = [t.encode() for t in texts]
        ids, n = self.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        cut = np.cumsum(n)
        return [ids[b - k:b].tobytes() for b, k in zip(cut, n)]


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each row, and the new row sizes."""
    size = n + 1
    out = np.full(int(size.sum()), end_id, ids.dtype)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size) - 1] = False
    out[inside] = ids
    return out, size


@lru_cache(maxsize=2)
def encoder(path: str, cut: str) -> Encoder:
    return Encoder(path, cut)
