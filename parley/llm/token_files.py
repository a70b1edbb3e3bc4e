"""Operator 8, token-id output: flat unsigned integer files with 64-bit
document offsets, read by memory mapping.

Documents are dealt by ranges of doc_id and sorted, so files in the order of
their number hold all documents in ascending order. A task encodes its range
and writes one flat file of ids (16 bits wide if the vocabulary fits, else 32)
and one of 64-bit document ids; its manifest row (counts and file names) is
committed by Spark, so files of lost attempts are never read. Prefix sums over
the manifest give each file's base, and a second pass over the manifest writes
the 64-bit offsets of all documents in the whole corpus.

Defined results: a null or empty text is the end id alone; null ids come first;
rows repeated with their id each get their ids; an empty table gives an empty
result; other columns are ignored."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import prepare, row_chunks, scratch_path, string_buffers, texts, written
from parley.llm.encoding import CHUNK, encoder, with_end
from parley.llm.packing import bases

END_ID = 0
_PART = "part int, n_docs long, n_null long, n_tokens long, width int, name string"


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://").removeprefix("file:") if uri.startswith(("file:", "/")) else None


def open_new(uri: str):
    """A new file in the shared folder, for writing."""
    if path := _local(uri):
        return open(path, "xb")
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path)


def mapped(uri: str, dtype: str, count: int) -> np.ndarray:
    """The numbers of a file, memory-mapped where the folder is mounted."""
    if not count:
        return np.zeros(0, dtype)
    if path := _local(uri):
        return np.memmap(path, dtype, "r", shape=(count,))
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype, count)


def _folder(spark, path: str) -> str:
    """Create the folder and return its full address."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(p)
    return store.makeQualified(p).toString()


def write_token_files(docs: DataFrame, tokenizer: str, cut: str = "spaced", end_id: int = END_ID, path: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files under ``path`` and return their manifest: part, n_docs,
    n_null, n_tokens, width, name, base (ids in all earlier files)."""
    spark = docs.sparkSession
    prepare(spark)
    path = _folder(spark, path or scratch_path(spark, "token-files"))
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, cut), TaskContext.get().partitionId()
        name, n_docs, n_null, n_tokens = f"{path}/part-{part:06d}-{uuid.uuid4().hex}", 0, 0, 0
        with open_new(f"{name}.bin") as ids_file, open_new(f"{name}.len") as len_file, open_new(f"{name}.doc") as doc_file:
            for b in batches:
                n_null += b.column(0).null_count
                doc_file.write(np.array(b.column(0).fill_null(0), "<i8").tobytes())
                data, offsets = string_buffers(b.column(1))
                for lo, hi in row_chunks(offsets, CHUNK):
                    ids, sizes = with_end(*enc.ids(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]), end_id)
                    ids_file.write(ids.tobytes())
                    len_file.write(sizes.astype("<i8").tobytes())
                    n_docs += hi - lo
                    n_tokens += len(ids)
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([n_null]), pa.array([n_tokens]),
            pa.array([enc.dtype.itemsize], pa.int32()), pa.array([name])], names=["part", "n_docs", "n_null", "n_tokens", "width", "name"])

    parts = written(ranged.mapInArrow(write, _PART).where("n_docs > 0"), "token-parts")
    based = parts.join(F.broadcast(bases(parts, "part", "n_tokens")), "part")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for r in b.to_pylist():
                sizes = np.array(mapped(f"{r['name']}.len", "<i8", r["n_docs"]))
                files.append(f"{r['name']}-{uuid.uuid4().hex}.off")
                with open_new(files[-1]) as f:
                    f.write((r["base"] + np.concatenate([[0], np.cumsum(sizes)])).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.string())], names=[*b.schema.names, "offsets"])

    return written(based.mapInArrow(offsets, f"{_PART}, base long, offsets string"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    # A task for each file: a shuffle of the small manifest by size would put
    # them all into one.
    last = manifest.agg(F.max("part")).first()[0]
    files = manifest.repartitionById((last or 0) + 1, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = r["n_docs"]
                ids = mapped(f"{r['name']}.bin", f"<u{r['width']}", r["n_tokens"])
                at = mapped(r["offsets"], "<u8", n + 1).astype(np.int64)
                doc = mapped(f"{r['name']}.doc", "<i8", n)
                local = at - at[0]
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(local[lo:hi], local[lo + 1:hi + 1])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(doc[lo:hi]), pa.int64(), mask=np.arange(lo, hi) < r["n_null"]), pa.array(at[lo:hi], pa.int64()),
                        pa.array(np.diff(at[lo:hi + 1]), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
