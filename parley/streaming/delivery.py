"""Delivery as a stream (OB-1, OB-2): every registered message is sent daily,
each occurrence exactly once.

Registrations and clock ticks arrive as one stream. The clock is the watermark:
a tick moves it on and the timers behind it fire. The first registration of a
message is kept by its id (a keyed state in the JVM); then messages are dealt by
a hash of their ids to ``parts`` groups. A group's state holds up to when all was
sent, the next occurrence, and its messages by time of day (a minute, so at most
1,440 times) in chunks; one timer waits for the next occurrence. When it fires,
the times that fell due since are read, their occurrences are emitted, and the
timer waits for the next time. So calls and frames grow with the groups, and
only rows with the messages. The state is the log of what was sent, so no
history is rebuilt: a tick costs what falls due at it. The result up to a tick
equals :func:`parley.operators.outbox.due_messages` at that time.

A registration may come late (its first occurrences are then sent at once); a
message that is registered again keeps its state. Occurrences of one micro-batch
go to its own folder, which a replay overwrites."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parley.operators import outbox
from parley.streaming.ingest import read_records, written_batches

DAY = 86_400_000
PARTS = 128  # groups of messages; fixed for a checkpoint
CHUNK = 500  # messages in one entry of the state; fixed for a checkpoint
FRAME = 10_000  # rows in one output frame
# One row per message: its occurrences of this batch, from the first to the last.
_SPAN = T.StructType([T.StructField("meeting_id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("message", T.StringType()),
                      T.StructField("due", T.LongType()), T.StructField("last", T.LongType())])
_EPOCH = "timestamp_ntz'1970-01-01'"


def _ms(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, {_EPOCH}, {ts})")


def _after(time: int, clock: int) -> int:
    """The first occurrence of a time of day after ``clock``."""
    return clock + 1 + (time - clock - 1) % DAY


def _frames(spans: Iterator[tuple], size: int) -> Iterator[pd.DataFrame]:
    while some := [*islice(spans, size)]:
        yield pd.DataFrame({f.name: pd.Series(c, dtype=object if i < 3 else "int64") for i, (f, c) in enumerate(zip(_SPAN.fields, zip(*some)))})


class DailyMessages(StatefulProcessor):
    """One group of messages: emits their occurrences up to the clock, one timer
    ahead."""

    def __init__(self, chunk: int = CHUNK, frame: int = FRAME) -> None:
        self._chunk, self._frame = chunk, frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # Up to when all was sent (null: nothing yet), the next occurrence, and
        # the number of messages at each time of day.
        self._plan = handle.getValueState("plan", "sent long, due long, times array<long>, sizes array<long>")
        self._jobs = handle.getMapState("jobs", "time long, chunk long", "jobs array<struct<meeting_id: string, key: string, message: string, due: long>>")

    def _read(self) -> tuple[int | None, int | None, dict[int, int]]:
        sent, due, times, sizes = self._plan.get() or (None, None, [], [])
        return sent, due, dict(zip(times, sizes))

    def _write(self, sent: int | None, due: int, times: dict[int, int]) -> None:
        self._plan.update((sent, due, [*times], [*times.values()]))

    def _wait(self, due: int) -> None:
        # Timers behind the watermark fire; one that equals it is due as well.
        self._handle.registerTimer(due - 1)

    def _add(self, time: int, n: int, jobs: list[tuple]) -> int:
        """Put ``jobs`` behind the ``n`` messages of a time of day."""
        while jobs:
            chunk, used = divmod(n, self._chunk)
            held = [tuple(job) for job in self._jobs.getValue((time, chunk))[0]] if used else []
            some, jobs = jobs[:self._chunk - used], jobs[self._chunk - used:]
            self._jobs.updateValue((time, chunk), (held + some,))
            n += len(some)
        return n

    def _due(self, times: dict[int, int], sent: int | None, clock: int) -> Iterator[tuple]:
        """What fell due after ``sent`` and up to the clock."""
        for time, n in times.items():
            after = _after(time, clock)
            start = None if sent is None else _after(time, sent)
            for chunk in range(-(-n // self._chunk) if start != after else 0):
                for job in self._jobs.getValue((time, chunk))[0]:
                    if job[3] < after:
                        yield (*job[:3], job[3] if start is None else max(job[3], start), after - DAY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent, before, times = self._read()
        due = before
        for batch in rows:
            batch = batch.loc[batch["meeting_id"].notna(), ["meeting_id", "key", "message", "due"]]
            if not len(batch):
                continue
            new = defaultdict(list)
            texts = batch[["meeting_id", "key", "message"]].astype(object)
            for job in zip(*texts.where(texts.notna(), None).to_dict("list").values(), batch["due"].astype("int64").tolist()):
                new[job[3] % DAY].append(job)
            if sent is not None:
                late = ((*job, _after(time, sent) - DAY) for time, jobs in new.items() for job in jobs if job[3] <= sent)
                yield from _frames(late, self._frame)
            for time, jobs in new.items():
                times[time] = self._add(time, times.get(time, 0), jobs)
                first = min(job[3] for job in jobs)
                first = first if sent is None else max(first, _after(time, sent))
                due = first if due is None else min(due, first)
        if due is not None:
            self._write(sent, due, times)
        if due != before:
            if before is not None:
                self._handle.deleteTimer(before - 1)
            self._wait(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sent, _, times = self._read()
        clock = timerValues.getCurrentWatermarkInMs()
        due = min(_after(time, clock) for time in times)
        self._write(clock, due, times)
        self._wait(due)
        yield from _frames(self._due(times, sent, clock), self._frame)

    def close(self) -> None:
        pass


def registrations(messages: DataFrame) -> DataFrame:
    """Rows of the stream from an outbox (:func:`outbox.build_outbox`)."""
    first = messages.withColumn("_first", outbox.first_run(F.col("registered_at"), F.col("send_at")))
    return first.select(F.col("meeting_id").cast("string").alias("meeting_id"), "key", "message", _ms("_first").alias("due"),
                        F.lit(None).cast("long").alias("clock"))


def ticks(times: DataFrame, now_col: str) -> DataFrame:
    """Rows of the stream from times of the clock (TIMESTAMP_NTZ)."""
    none = F.lit(None).cast("string")
    return times.select(none.alias("meeting_id"), none.alias("key"), none.alias("message"), F.lit(None).cast("long").alias("due"), _ms(now_col).alias("clock"))


def stream_deliveries(source: DataFrame, path: str, checkpoint: str, once: bool = False, parts: int = PARTS) -> StreamingQuery:
    """Start the delivery: ``source`` is a stream of :func:`registrations` and
    :func:`ticks`; sent occurrences are appended under ``path``."""
    timed = source.withColumn("at", F.timestamp_millis("clock")).withWatermark("at", "0 seconds")
    # A tick only moves the watermark. The filter reads ``at``, so it stays above it.
    first = timed.filter(F.col("at").isNull()).dropDuplicates(["meeting_id", "key"])
    dealt = first.withColumn("part", F.pmod(F.xxhash64("meeting_id", "key"), F.lit(parts)))
    spans = dealt.groupBy("part").transformWithStateInPandas(DailyMessages(), _SPAN, "Append", "EventTime")
    sent = spans.withColumn("due", F.explode(F.expr(f"sequence(due, last, {DAY}L)"))).drop("last")
    return written_batches(sent, checkpoint, lambda batch: {path: batch}, once, kept=False)


def sent_messages(spark, path: str) -> DataFrame:
    """``(meeting_id, key, message, occurrence)`` of everything sent."""
    at = F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, due / 1000.0)")
    return read_records(spark, path).select("meeting_id", "key", "message", at.alias("occurrence"))
