"""Fixed schemas of the tables the engine reads and writes (SNK-2, §1.4)."""

from __future__ import annotations

from pyspark.sql import types as T

# Stored meeting row: nested values kept as JSON text, one row per meeting.
MEETINGS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("sales_id", T.StringType(), True),
    T.StructField("meeting_ts", T.TimestampNTZType(), True),
    T.StructField("analysis_json", T.StringType(), True),
    T.StructField("pdfs_json", T.StringType(), True),
    T.StructField("followup_json", T.StringType(), True),
    T.StructField("scoring_json", T.StringType(), True),
])

ANALYSIS_SCHEMA = T.StructType([
    T.StructField("topics", T.ArrayType(T.StringType()), True),
    T.StructField("fears", T.StringType(), True),
    T.StructField("objection", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
])

CORPUS_SCHEMA = T.StructType([
    T.StructField("sector", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("ordinal", T.LongType(), True),
    T.StructField("text", T.StringType(), True),
])
