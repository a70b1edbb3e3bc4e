"""Transcript and meeting sources (SRC-1..3, SNK-2, SNK-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import base_name
from parley.operators.meetings import NEWEST_FIRST
from parley.operators.ordering import positioned
from parley.schemas import MEETINGS_SCHEMA
from parley.sources.paths import below


def read_transcripts(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """SRC-1: one row per file ``(meeting_id, path, text)``; the id is the
    file's path below ``path`` without extension (the base name for files
    directly in it), so equal names in two folders keep two ids.

    Text mode reads UTF-8 whole files. ``binary=True`` reads the bytes and
    drops invalid UTF-8 sequences, like ``decode("utf-8", errors="ignore")``
    (a genuine U+FFFD in the input is dropped too)."""
    if binary:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
        df = raw.select("path", text.alias("text"))
    else:
        df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"),
                                                         F.col("value").alias("text"))
    inside = below(spark, path, F.col("path"))
    mid = F.regexp_replace(F.coalesce(inside, base_name(F.col("path"))), r"\.[^./]*$", "")
    return df.select(mid.alias("meeting_id"), "path", "text")


def resolve_transcript(file_text: Column, pasted_text: Column) -> Column:
    """SRC-2: an uploaded file overrides pasted text."""
    return F.coalesce(file_text, pasted_text)


def ensure_meetings_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """SNK-2: create the meetings table if missing (Parquet). Spark does not
    enforce the key; :func:`parley.operators.meetings.save_meetings` does."""
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MEETINGS_SCHEMA.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}")


def load_meetings(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: stored meetings with the fixed schema (columns are pruned and
    filters pushed to Parquet by Catalyst) and ``position``, newest first."""
    return positioned(spark.read.schema(MEETINGS_SCHEMA).parquet(path), NEWEST_FIRST)


def to_report_json(df: DataFrame) -> DataFrame:
    """SNK-5: one JSON document per row, non-ASCII kept as is."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
