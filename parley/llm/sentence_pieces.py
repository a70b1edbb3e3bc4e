"""Operator 12, SentencePiece encoding and decoding for merge-type (BPE)
vocabularies.

A text becomes symbols, one a character, with every space written as U+2581 and
one more in front. An agenda holds the adjacent pairs whose joined text is a
piece of the vocabulary, best score first and leftmost among equals; the top
pair is merged and its new neighbours enter, until the agenda is empty. A
symbol that is no piece falls back to its UTF-8 bytes. Decoding joins the
pieces' bytes and takes the one space in front away again.

No merge can cross two characters that no piece holds side by side, so a text
is cut there. The parts of the new words of a batch are merged together: row by
row a table holds a part's symbols and the scores of its pairs, and each step
merges every row's top pair. Parts of more than ``ROW`` characters have an
agenda of their own, a heap. A word is merged once per worker and kept (at most
about ``KEEP_BYTES`` of words). In each Arrow batch the sentencepiece library
encodes and decodes the whole texts too; ``agrees`` says whether its ids and
its text equal those of the agenda.

Defined results: a null or empty text has no ids and decodes to the empty text;
null ids and repeated rows each get their row; control pieces written in a text
are ordinary characters; an empty table gives an empty result; other columns
are ignored. Models with another normaliser, without byte fallback, or with
user-defined or unused pieces are refused with a ValueError."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import prepare, row_chunks, string_buffers, texts
from parley.llm.encoding import Encoder

SPACE = "▁"
CHUNK = 2 << 20
KEEP_BYTES = 32 << 20
ROW = 24  # characters of a part that is merged in a table
ROWS = 1 << 15  # parts merged together

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

# The library replaces each byte that is no UTF-8, not each run of them.
codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """Pieces, scores and decoded bytes of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
        self.library = SentencePieceProcessor(model_file=path)
        model = ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules, made = model.normalizer_spec, model.trainer_spec
        if (rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
                or not rules.escape_whitespaces or made.treat_whitespace_as_suffix):
            raise ValueError("the model's normaliser is not supported")
        if made.model_type != made.BPE or not made.byte_fallback or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("a merge-type model with byte fallback and no user-defined or unused pieces is needed")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        #: Characters that some piece holds side by side.
        self.touching = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self._touching = np.sort(np.array([ord(t[0]) << 21 | ord(t[1]) for t in self.touching] or [-1], np.int64))
        # Symbols by number: pieces by id, other characters behind the ids.
        self.first_other = len(model.pieces)
        self.dtype = np.dtype("<u2" if self.first_other <= 1 << 16 else "<u4")
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.first_other
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        # All pairs of symbols that make a piece, the piece and its rank.
        rank = {s: i for i, s in enumerate(sorted(set(self.score.values())))}
        pairs = {}
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                x, y = self._number(piece[:at]), self._number(piece[at:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = i, rank[self.score[piece]]
        self.pair = np.array(sorted(pairs) or [-1], np.int64)
        self.made, self.rank = np.array([pairs[k] for k in sorted(pairs)] or [(0, -1)], np.int32).T
        self.shown = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == UNKNOWN
                      else b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.opens = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.silent = np.array([p.type == CONTROL for p in model.pieces])
        self.at = np.cumsum([0, *map(len, self.shown)])
        self.bytes = np.frombuffer(b"".join(self.shown), np.uint8)

    def _number(self, text: str) -> int | None:
        return int(self.symbol[ord(text)]) if len(text) == 1 else self.ids.get(text)

    def merged(self, text: str) -> list[str]:
        """The symbols left when the agenda of pairs is empty."""
        symbols, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-s, i, i + 1, 2) for i in range(n - 1) if (s := self.score.get(text[i:i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, a, b, size = heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one of the two has been merged since
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y >= 0 and (s := self.score.get(symbols[x] + symbols[y])) is not None:
                    heappush(agenda, (-s, x, y, len(symbols[x]) + len(symbols[y])))
        return [s for s in symbols if s]

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two symbols make and its rank, -1 for none."""
        key = x.astype(np.int64) << 32 | y
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        fits = (self.pair[at] == key) & (x >= 0) & (y >= 0)
        return self.made[at], np.where(fits, self.rank[at], -1)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Parts as rows of symbols, filled with -1 (at least one in each row):
        the symbols that are left, in the same form."""
        out, left, column = rows.copy(), np.arange(len(rows)), np.arange(rows.shape[1])
        made, rank = np.zeros_like(rows), np.full_like(rows, -1)
        made[:, :-1], rank[:, :-1] = self._pairs(rows[:, :-1], rows[:, 1:])
        while len(left):
            top = rank.argmax(axis=1)  # the leftmost among equals
            more = rank[np.arange(len(left)), top] >= 0
            if not more.all():
                out[left[~more]] = rows[~more]
                left, rows, made, rank, top = left[more], rows[more], made[more], rank[more], top[more]
            if not len(left):
                break
            each = np.arange(len(left))
            rows[each, top] = made[each, top]
            # The column behind the merged one goes; its pairs are looked up anew.
            take = np.minimum(column + (column > top[:, None]), len(column) - 1)
            rows, made, rank = (np.take_along_axis(m, take, axis=1) for m in (rows, made, rank))
            rows[:, -1], rank[:, -1] = -1, -1
            made[each, top], rank[each, top] = self._pairs(rows[each, top], rows[each, top + 1])
            back = np.flatnonzero(top > 0)
            at = top[back]
            made[back, at - 1], rank[back, at - 1] = self._pairs(rows[back, at - 1], rows[back, at])
        return out

    def _spelled(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of flat symbols and the new row sizes: a symbol that is no piece
        becomes its bytes."""
        other = np.flatnonzero(symbols >= self.first_other)
        if not len(other):
            return symbols, sizes
        spelled = [[self.byte_ids[b] for b in chr(c).encode()] for c in (symbols[other] - self.first_other).tolist()]
        width = np.ones(len(symbols), np.int64)
        width[other] = [len(x) for x in spelled]
        out = np.repeat(symbols, width)
        out[np.repeat(symbols >= self.first_other, width)] = [i for x in spelled for i in x]
        ends = np.cumsum(sizes)
        at = np.concatenate([[0], np.cumsum(width)])
        return out, at[ends] - at[ends - sizes]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of texts that are not empty and whose spaces are escaped, the one
        in front included."""
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        flat = self.symbol[points]
        key = points[:-1].astype(np.int64) << 21 | points[1:]
        cut = np.ones(len(points), bool)
        at = np.minimum(np.searchsorted(self._touching, key), len(self._touching) - 1)
        cut[1:] = self._touching[at] != key
        cut[np.cumsum(size)[:-1]] = True
        start = np.flatnonzero(cut)
        width = np.diff(np.append(start, len(points)))
        symbols, held = flat.copy(), np.ones(len(points), bool)  # a part's symbols stand at its front
        for low, high in ((1, 4), (4, 8), (8, 16), (16, ROW)):
            parts = np.flatnonzero((width > low) & (width <= high))
            for lo in range(0, len(parts), ROWS):
                p = parts[lo:lo + ROWS]
                column = np.arange(high + 1)
                own = column < width[p][:, None]
                place = np.minimum(start[p][:, None] + column, len(points) - 1)
                rows = self.merge_rows(np.where(own, flat[place], -1))
                symbols[place[own]] = rows[own]
                held[place[own]] = rows[own] >= 0
        for p in np.flatnonzero(width > ROW).tolist():
            a, z = int(start[p]), int(start[p] + width[p])
            done = [self._number(x) for x in self.merged(points[a:z].tobytes().decode("utf-32-le"))]
            symbols[a:a + len(done)] = done
            held[a + len(done):z] = False
        kept = np.concatenate([[0], np.cumsum(held)])
        ends = np.cumsum(size)
        ids, sizes = self._spelled(symbols[held], kept[ends] - kept[ends - size])
        ids, stop = ids.astype(self.dtype), np.cumsum(sizes).tolist()
        return [ids[a:z] for a, z in zip([0, *stop], stop)]

    def _joined(self, ids: np.ndarray) -> bytes:
        size = self.at[ids + 1] - self.at[ids]
        stop = np.cumsum(size)
        return self.bytes[np.arange(stop[-1]) + np.repeat(self.at[ids] - stop + size, size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids; control pieces are silent, and the bytes before
        and behind one make no character together."""
        silent = self.silent[ids]
        heard = np.flatnonzero(~silent)
        if not len(heard):
            return ""
        runs = np.split(heard, np.flatnonzero(np.diff(heard) > 1) + 1) if silent.any() else [heard]
        raw = [self._joined(ids[r]) for r in runs]
        if self.opens[ids[heard[0]]]:
            raw[0] = raw[0][1:]
        return "".join(r.decode("utf-8", "each-byte") for r in raw)


def escaped_units(data: np.ndarray, offsets: np.ndarray):
    """Units that start at a space after another character. No piece may hold a
    space behind another character; ``PieceEncoder`` makes sure of it."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 0, data[:-1]
    # 0x81 may be the end of a U+2581 in the text itself.
    cut = (data == 0x20) & (before != 0x20) & (before != 0x81)
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(offsets, starts, side="right") - 1


def one_unit(data: np.ndarray, offsets: np.ndarray):
    """Each text that is not empty as one unit."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    return offsets[rows], offsets[rows + 1], rows


class PieceEncoder(Encoder):
    """The piece cache of ``Encoder`` with the agenda as its tokenizer."""

    def __init__(self, path: str) -> None:
        self.words = Vocabulary(path)
        self.dtype = self.words.dtype
        crossing = any(b == SPACE and a != SPACE for a, b in self.words.touching)
        self.cut = one_unit if crossing else escaped_units
        self._forget()

    def _encoded(self, words: list[bytes]) -> list[np.ndarray]:
        return self.words.encode_words([w.decode().replace(" ", SPACE) for w in words]) if words else []

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a UTF-8 buffer, and their number in each row."""
        if self.kept_bytes() > KEEP_BYTES:
            self._forget()
        some = np.diff(offsets) > 0
        fronted = np.insert(data, offsets[:-1][some], 0x20)
        return super().ids(fronted, offsets + np.concatenate([[0], np.cumsum(some)]))


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def sentence_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, decoded, agrees (ids and
    decoded text equal the library's)."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(model)
        for b in batches:
            data, offsets = string_buffers(b.column(1))
            for lo, hi in row_chunks(offsets, CHUNK):
                ids, sizes = enc.ids(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                ids = ids.astype(np.int32)
                at = np.concatenate([[0], np.cumsum(sizes)])
                own = [ids[x:y] for x, y in zip(at[:-1], at[1:])]
                decoded = [enc.words.decode(x) for x in own]
                library = enc.words.library.encode(b.column(1).slice(lo, hi - lo).to_pylist(), num_threads=1)
                back = enc.words.library.decode(library, num_threads=1)
                agrees = [len(x) == len(y) and bool((x == np.array(y, np.int32)).all()) and t == u
                          for x, y, t, u in zip(own, library, decoded, back)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                    pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=["doc_id", "ids", "decoded", "agrees"])

    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
