"""Transcripts arriving one by one (STR-1, PL-6).

A stream of ``(meeting_id, text)`` passes a keyed state that knows every id
seen so far: the first text of an id is new, later ones are rejected (JN-1).
The state lives in the checkpoint (RocksDB, by id), so a batch costs its own
rows however many meetings are stored; the table is read once, when a new
checkpoint starts over a table that already holds meetings.

New texts are processed per micro-batch with ``foreachBatch``: blank ones are
dropped (PRJ-23), the records are built (RL-10 ranks documents with
``row_number``, which must run as batch code) and written to the batch's own
folder, ``stream=<id>/batch=<number>``. A batch that is replayed after a failure
finds the state of the batch before and overwrites that folder, so it adds
nothing. One stream writes a table at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parley.functions.text import base_name
from parley.operators import meetings, rules
from parley.plans import flows
from parley.sources.paths import below, exists

KEY = "meeting_id"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ARRIVALS = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("text", T.StringType()), T.StructField("is_new", T.BooleanType())])


class FirstArrivals(StatefulProcessor):
    """Marks the first text of each id; the state holds a flag per id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self._seen.exists()
        if not seen:
            self._seen.update((True,))
        for batch in rows:
            fresh = [not seen, *[False] * (len(batch) - 1)] if len(batch) else []
            seen = seen or len(batch) > 0
            yield batch.assign(is_new=fresh)[[KEY, "text", "is_new"]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._seen.update((True,))

    def close(self) -> None:
        pass


def read_records(spark: SparkSession, table_path: str) -> DataFrame:
    """The stored records of all streams and appends."""
    return spark.read.parquet(table_path).drop("stream", "batch")


def followup_batch(batch: DataFrame, catalog: DataFrame, cache: DataFrame,
                   words: rules.RuleWords = rules.DEFAULT_WORDS, key: str = KEY) -> DataFrame:
    """PL-1 on one batch of ``(key, text)``: the 11-field record."""
    return flows.generate_followups(batch, catalog, cache, key, words)


def append_new(spark: SparkSession, records: DataFrame, table_path: str, key: str = KEY) -> int:
    """Append records whose key is not stored yet, in a folder of their own
    (batch use, beside no running stream). Returns the number of rows appended."""
    stored = (read_records(spark, table_path).select(F.col(key).alias("id"))
              if exists(spark, table_path) else spark.createDataFrame([], "id string"))
    new = records.withColumn("id", F.col(key)).withColumn("_order", F.lit(0))
    saved, _ = meetings.save_meetings(stored, new, order_col="_order")
    folder = f"{table_path.rstrip('/')}/stream=append-{uuid.uuid4().hex}/batch=0"
    saved = saved.drop("id", "_order")
    saved.write.parquet(folder)
    return spark.read.schema(saved.schema).parquet(folder).count()


def transcript_files(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """A stream of text files, one transcript each. The id is the file's path
    below ``source_dir`` (below its part without wildcards), with its extension,
    so files of one name in two folders, or of two kinds, stay apart."""
    parts = source_dir.split("/")
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[{")), len(parts))
    path = F.col("_metadata.file_path")
    return (spark.readStream.format("text").option("wholetext", "true")
            .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir)
            .select(F.coalesce(below(spark, "/".join(parts[:fixed]) or "/", path), base_name(path)).alias(KEY), F.col("value").alias("text")))


def stream_records(source: DataFrame, table_path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame],
                   rejected_path: str | None = None, once: bool = False) -> StreamingQuery:
    """Start the stream: ``source`` is a streaming ``(meeting_id, text)``;
    ``build`` turns the new texts of a batch into the records to store. Texts
    with an id that is stored go to ``rejected_path``, if given. ``once`` stops
    when all data that is there now is processed."""
    spark = source.sparkSession
    resumed = exists(spark, f"{checkpoint}/metadata")
    known = (spark.createDataFrame([], f"{KEY} string") if resumed or not exists(spark, table_path)
             else read_records(spark, table_path).select(KEY).distinct())
    marked = source.select(KEY, "text").groupBy(KEY).transformWithStateInPandas(
        FirstArrivals(), _ARRIVALS, "Append", "None", known.groupBy(KEY))

    def parts(marks: DataFrame) -> dict[str, DataFrame]:
        new = build(marks.filter("is_new").drop("is_new"))
        return {table_path: new, rejected_path: marks.filter("NOT is_new").drop("is_new")} if rejected_path else {table_path: new}

    return written_batches(marked, checkpoint, parts, once)


def written_batches(stream: DataFrame, checkpoint: str, parts: Callable[[DataFrame], dict[str, DataFrame]], once: bool = False,
                    kept: bool = True) -> StreamingQuery:
    """Start a stateful stream whose batches are written to folders of their
    own: ``parts`` gives the rows of a batch for each table's path. Without
    ``kept`` they are not held for a second reading: one table takes them as
    they are."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        # The stream's own id is new with a new checkpoint, so its folders never
        # meet those of an earlier one.
        own = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        if kept:
            batch.persist()  # several tables may read it
        try:
            for path, rows in parts(batch).items():
                rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream={own}/batch={number}")
        finally:
            if kept:
                batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # taken over by the query when it starts
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def stream_followups(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                     catalog: DataFrame, cache: DataFrame, words: rules.RuleWords = rules.DEFAULT_WORDS,
                     max_files_per_trigger: int = 1000, rejected_path: str | None = None) -> StreamingQuery:
    """Text files in ``source_dir`` -> follow-up records in ``table_path``."""
    return stream_records(transcript_files(spark, source_dir, max_files_per_trigger), table_path, checkpoint,
                          lambda batch: followup_batch(batch, catalog, cache, words), rejected_path)
