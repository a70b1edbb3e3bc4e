"""Operator 2, packing by concatenate and cut.

Pass one encodes every document (its ids and an end id) and notes, inside each
partition, the ids before it; the rows are written, so partition numbers and
places are fixed for good. The partitions' totals give their bases by a prefix
sum over one row per partition. Pass two cuts the global sequence into fixed
windows: a document that crosses window borders becomes one boundary record per
window. No document is moved: there is no shuffle of ids.

Every sequence but the last is full, so padding is at most one window for the
whole corpus.

Defined results: a null or empty text is the end id alone; null ids and
repeated rows are packed like any other; an empty table gives an empty result;
other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from parley.llm.common import prepare, row_chunks, string_buffers, texts, written
from parley.llm.encoding import CHUNK, encoder, with_end

LENGTH = 2048
END_ID = 1


def encoded(docs: DataFrame, tokenizer: str, cut: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, pos, doc_id, n, ids): each document's ids with the end id, its
    partition and the ids before it there. To be written before use."""
    rows = texts(docs, id_col, text_col)
    schema = StructType([StructField("part", IntegerType()), StructField("pos", LongType()),
                         StructField("doc_id", rows.schema["doc_id"].dataType), StructField("n", LongType()),
                         StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, pos = encoder(tokenizer, cut), TaskContext.get().partitionId(), 0
        for b in batches:
            data, offsets = string_buffers(b.column(1))
            for lo, hi in row_chunks(offsets, CHUNK):
                ids, n = with_end(*enc.ids(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]), end_id)
                ends = np.cumsum(n)
                blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [
                    None, pa.py_buffer(np.concatenate([[0], ends * enc.dtype.itemsize])), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), part), pa.int32()), pa.array(pos + ends - n, pa.int64()), b.column(0).slice(lo, hi - lo),
                    pa.array(n, pa.int64()), blobs], names=schema.names)
                pos += int(ends[-1])

    return rows.mapInArrow(run, schema)


def bases(totals: DataFrame, key: str, size: str) -> DataFrame:
    """(key, base): the sum of ``size`` over all smaller keys. One row per
    partition of the data, so a window over all of them is small."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(size).over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, tokenizer: str, cut: str = "word", length: int = LENGTH, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids (little-endian, of the encoder's width)."""
    prepare(docs.sparkSession)
    tokens = written(encoded(docs, tokenizer, cut, end_id, id_col, text_col), "packing-tokens")
    base = bases(tokens.groupBy("part").agg(F.sum("n").alias("total")), "part", "total")
    # One row per partition: small whatever the size of the corpus.
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("pos")).alias("at"), "ids")
    long = LongType()
    schema = StructType([StructField("doc_id", placed.schema["doc_id"].dataType), StructField("start", long),
                         StructField("length", long), StructField("ids_crc32", long), StructField("doc_tokens", long),
                         StructField("sequence_id", long), StructField("offset", long), StructField("ids", BinaryType())])

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer, cut).dtype
        for b in batches:
            row, out = [], []
            for i, (at, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                for w in range(at // length, (at + len(ids) - 1) // length + 1):
                    lo, hi = max(at, w * length) - at, min(at + len(ids), (w + 1) * length) - at
                    piece = ids[lo:hi]
                    row.append(i)
                    out.append((lo, hi - lo, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), w, at + lo - w * length, piece.tobytes()))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())],
                names=schema.names)

    return placed.mapInArrow(cut_windows, schema)
