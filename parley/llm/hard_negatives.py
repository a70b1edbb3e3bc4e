"""Operator 13, hard-negative mining by a secondary sort.

Rows whose id is divisible by ``every`` are anchors. Scores are inner products
of integer vectors. Anchors go to the tasks in blocks of about ``BLOCK`` (the
bound of what is sent), and each block is scored against all rows:

1. each task keeps its best ``n_positives`` rows of an anchor's label, and a
   window per anchor merges them: the positives and their scores;
2. each positive opens a window of scores, from ``low`` percent of its own
   score up to it. Each task keeps, for every window, its first ``n_negatives``
   rows of another label. No row beyond them can be among the first of all;
3. positives and kept negatives become pairs with the packed key (anchor,
   descending score, positives first, id). ``repartitionAndSortWithinPartitions``
   deals them by anchor and sorts them, and an iterator walks each partition:
   a positive opens its window, a negative is written to every open window, a
   window closes when it is full or the score falls below it. The iterator
   holds the open windows of one anchor only.

Defined results: a row with a null label, a null vector or a null or non-finite
component takes no part; missing components of a shorter vector count as zero;
rows repeated with their id are rows of their own, also as anchors; a null id is
no anchor and comes last among equal scores; an anchor without positives has no
row; an empty table gives an empty result; other columns are ignored. Scores
beyond 64 bits raise an OverflowError."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from parley.llm.common import prepare, written

BLOCK = 1024
ROWS = 2048
HELD = 1 << 18
EXACT = 1 << 53
LEAST_LONG = -(1 << 63)

RESULT = StructType([StructField("anchor_id", LongType()), StructField("positive_id", LongType()), StructField("rank", IntegerType()),
                     StructField("negative_id", LongType()), StructField("positive_score", LongType()), StructField("negative_score", LongType())])
_FOUND = "anchor long, slot int, score long, uid long, id long"


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """uid, id, label, vector (whole numbers) of the rows that take part."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"), whole.alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, cut or filled with zeros to ``width``."""
    if pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(pa.int64()))
    at = column.offsets.to_numpy().astype(np.int64)
    size, flat = np.diff(at), column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row, place = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices."""
    most = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) >= 1 << 63:
        raise OverflowError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


class _First:
    """The first ``k`` rows of each slot: higher scores, then smaller ids."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.held = k, 0
        self.least, self.last = np.full(slots, LEAST_LONG), np.full(slots, np.iinfo(np.int64).max)
        self.parts = [np.zeros((0, 5), np.int64)]

    def offer(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, uid: np.ndarray, id_: np.ndarray, known: np.ndarray) -> None:
        """Scores of slots x rows, of which only the allowed ones count."""
        least = self.least[slots][:, None]
        s, r = np.nonzero(allowed & (scores >= least))
        value, slot = scores[s, r], slots[s]
        late = (value == self.least[slot]) & (~known[r] | (id_[r] > self.last[slot]))
        s, r, value, slot = s[~late], r[~late], value[~late], slot[~late]
        self.parts.append(np.stack([slot, value, ~known[r], id_[r], uid[r]], axis=1))
        self.held += len(s)
        if self.held > HELD:
            self.cut()

    def cut(self) -> np.ndarray:
        t = np.concatenate(self.parts)
        t = t[np.lexsort((t[:, 4], t[:, 3], t[:, 2], -t[:, 1], t[:, 0]))]
        rank = np.arange(len(t)) - np.searchsorted(t[:, 0], t[:, 0])
        end = t[rank == self.k - 1]
        self.least[end[:, 0]] = end[:, 1]
        self.last[end[:, 0]] = np.where(end[:, 2] == 1, np.iinfo(np.int64).max, end[:, 3])
        t = t[rank < self.k]
        self.parts, self.held = [t], 0
        return t


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            ids = part.column(1)
            yield (part.column(0).to_numpy(), ids.fill_null(0).to_numpy(), np.array(ids.is_valid()),
                   part.column(2).to_numpy(), matrix(part.column(3), width))


def _found(t: np.ndarray, anchor: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(anchor), pa.array(slot.astype(np.int32)), pa.array(t[:, 1]), pa.array(t[:, 4]),
        pa.array(t[:, 3], mask=t[:, 2] == 1)], names=["anchor", "slot", "score", "uid", "id"])


def positives(rows: DataFrame, anchors: dict[str, np.ndarray], k: int) -> DataFrame:
    """Each task's first ``k`` other rows of each anchor's label."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _First(len(anchors["uid"]), k)
        every = np.arange(len(anchors["uid"]))
        for uid, id_, known, label, vector in _batches(batches, anchors["vector"].shape[1]):
            allowed = (anchors["label"][:, None] == label) & (anchors["uid"][:, None] != uid)
            first.offer(every, products(anchors["vector"], vector), allowed, uid, id_, known)
        t = first.cut()
        yield _found(t, anchors["uid"][t[:, 0]], np.zeros(len(t)))

    return rows.mapInArrow(find, _FOUND)


def negatives(rows: DataFrame, anchors: dict[str, np.ndarray], opened: np.ndarray, k: int, low: int) -> DataFrame:
    """Each task's first ``k`` rows of every window: opened[anchor, slot] is a
    positive's score, or -1 if there is none (a score below zero has an empty
    window)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, slots = opened.shape
        first = _First(n * slots, k)
        # low * score <= 100 * other, in whole numbers without overflow
        floor = np.array([[-(-low * int(p) // 100) for p in row] for row in opened.tolist()], np.int64).reshape(n, slots)
        for uid, id_, known, label, vector in _batches(batches, anchors["vector"].shape[1]):
            score = products(anchors["vector"], vector)
            other = anchors["label"][:, None] != label
            for j in range(slots):
                use = np.flatnonzero(opened[:, j] >= 0)
                own = score[use]
                allowed = other[use] & (own <= opened[use, j][:, None]) & (own >= floor[use, j][:, None])
                first.offer(use * slots + j, own, allowed, uid, id_, known)
        t = first.cut()
        yield _found(t, anchors["uid"][t[:, 0] // slots], 1 + t[:, 0] % slots)

    return rows.mapInArrow(find, _FOUND)


_KEY = struct.Struct(">QQBBQQ")


def packed(anchor: int, score: int, kind: int, id_: int | None, uid: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives before
    negatives, id (null last) and row."""
    return _KEY.pack(anchor, (1 << 63) - 1 - score, kind, id_ is None, (id_ or 0) + (1 << 63), uid)


def unpacked(key: bytes) -> tuple[int, int, int, int | None, int]:
    anchor, score, kind, null, id_, uid = _KEY.unpack(key)
    return anchor, (1 << 63) - 1 - score, kind, None if null else id_ - (1 << 63), uid


def walk(pairs: Iterator[tuple[bytes, int | None]], n_negatives: int, low: int) -> Iterator[Row]:
    """Triples from sorted pairs, one pass, holding the open windows only."""
    at, open_, last = None, [], None
    for key, anchor_id in pairs:
        anchor, score, kind, id_, uid = unpacked(key)
        if anchor != at:
            at, open_, last = anchor, [], None
        if kind == 0:
            if score >= 0:
                open_.append([id_, score, 0])
            continue
        if key == last:
            continue  # kept for several windows
        last = key
        open_ = [w for w in open_ if w[2] < n_negatives and low * w[1] <= 100 * score]
        for w in open_:
            w[2] += 1
            yield Row(anchor_id, w[0], w[2], id_, w[1], score)


def hard_negatives(rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, low: int = 80, scale: int = 256,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    prepare(spark)
    base = written(usable(rows, id_col, vector_col, label_col, scale), "negatives-rows")
    chosen = base.where(F.col("id") % every == 0)
    blocks = max(1, -(-chosen.count() // block))
    cut, found = F.pmod(F.xxhash64("uid"), F.lit(blocks)), []
    for number in range(blocks):
        part = chosen.where(cut == number).orderBy("uid").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        width = int(np.max(np.diff(_offsets(part.column("vector"))), initial=0))
        anchors = {"uid": part.column("uid").to_numpy(), "label": part.column("label").to_numpy(),
                   "vector": matrix(_one(part.column("vector")), width)}
        ids = dict(zip(anchors["uid"].tolist(), part.column("id").to_pylist()))
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
        best = written(positives(base, anchors, n_positives).withColumn("slot", F.row_number().over(order))
                       .where(F.col("slot") <= n_positives), "negatives-positives")
        opened = np.full((part.num_rows, n_positives), -1, np.int64)
        top = best.select("anchor", "slot", "score").toArrow()
        opened[np.searchsorted(anchors["uid"], top.column("anchor").to_numpy()), top.column("slot").to_numpy() - 1] = top.column("score").to_numpy()
        near = written(negatives(base, anchors, opened, n_negatives, low), "negatives-near")
        both = best.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))
        pairs = both.rdd.map(lambda r, ids=ids: (packed(r.anchor, r.score, r.kind, r.id, r.uid), ids[r.anchor]))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = pairs.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8]))
        triples = dealt.mapPartitions(lambda it: walk(it, n_negatives, low))
        found.append(written(spark.createDataFrame(triples, RESULT, verifySchema=False), "negatives-triples"))
    out = found[0] if found else spark.createDataFrame([], RESULT)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _offsets(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(_one(column).offsets)
