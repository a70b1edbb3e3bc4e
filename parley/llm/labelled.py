"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import remainder, texts, written


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, y, text) of at most ``bound`` labelled documents, chosen by a
    hash of the id among those whose crc32 remainder is not ``held``. A
    document labelled twice counts as 1 if any label is 1; rows repeated with
    their id count once. The list of ids is broadcast: it has ``bound`` rows at
    most, whatever the size of the tables."""
    marked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    ids = marked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = texts(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    return written(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).repartition(8), "training-rows")
