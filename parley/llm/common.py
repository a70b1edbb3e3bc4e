"""Shared helpers of the training-data operators: reading tables, cutting
lineage with written tables, and Arrow column access inside tasks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from parley.session import ensure_checkpoint_dir, ship_package

#: ASCII white space [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The two columns every operator needs, under fixed names: ``doc_id``
    and ``text`` (a null text is the empty text), and with ``row_col`` that
    column as ``row``. Other columns, whatever their names, are left behind."""
    row = [F.col(row_col).alias("row")] if row_col else []
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)


def rowed(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with one more column, a struct that names each row for good:
    its file and its place there. Rows that do not come straight from files
    are written first."""
    try:
        at = docs.metadataColumn("_metadata")
        out = docs.select("*", F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("index")).alias(name))
        out.schema  # analysed here
        return out
    except AnalysisException:
        if hasattr(docs, "_scratch_path"):
            raise
        return rowed(written(docs, "rows"), name)


def remainder(id_col, modulus: int):
    """crc32 of the id as text, mod ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (shared by all executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage ends there, so a lost executor never repeats the work behind it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t._scratch_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch between Spark and a worker, on both sides of which a
#: task holds one at a time.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, name the shared folder and bound the
    Arrow batches, unless the session has a smaller bound."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (first 0) of an Arrow string column
    without nulls."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    off = np.frombuffer(off, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, limit: int):
    """Consecutive row ranges whose texts hold about ``limit`` bytes (a
    single longer row is a range of its own)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
