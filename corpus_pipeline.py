"""The corpus pipeline: stages over the documents table, each written as
Parquet and read again as the next one's documents.

Order: quality classifier (operator 9), exact dedup (6), SimHash near-dedup
(7), benchmark decontamination (4), packing (2). Each filtering stage calls its
operator on all documents that are left and drops the rows it decided against;
rows are told apart by their place in the files, so repeated and null ids are
safe. The other columns of the documents pass through."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import drop, prepare, rowed, table, written
from parley.llm.decontaminate import decontamination
from parley.llm.exact_dedup import exact_dedup
from parley.llm.packing import pack
from parley.llm.quality_crf import quality
from parley.llm.simhash import simhash_near_dedup

ROW = "row_of_file"


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (with ROW) less the rows listed in ``gone``, with the columns
    of the documents."""
    gone = written(gone.select(F.col("row").alias(ROW)), "gone")
    return docs.join(gone, ROW, "left_anti").drop(ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    docs = rowed(docs, ROW)
    scored = quality(docs, table(spark, sf_dir, "labels"), row_col=ROW)
    return without(docs, scored.where("predicted = 0"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    docs = rowed(docs, ROW)
    return without(docs, exact_dedup(docs, row_col=ROW).where("NOT kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays
    (one without an id only if none has one)."""
    docs = rowed(docs, ROW)
    marked = simhash_near_dedup(docs, row_col=ROW).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    best = marked.groupBy("root").agg(F.min("rank").alias("best"))
    return without(docs, marked.join(best, "root").where("rank <> best"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = rowed(docs, ROW)
    found = decontamination(docs, table(spark, sf_dir, "benchmark"), row_col=ROW)
    return without(docs, found.where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids, cut into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage),
          ("benchmark decontamination", benchmark_stage), ("packing", packing_stage)]

#: The classifier stage cannot be written in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}")
        if before is not None:
            drop(before)
        before = docs
    return docs
