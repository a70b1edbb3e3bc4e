"""The delivery stream against the batch query for the same clock."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from parley import fixtures as fx
from parley.operators import outbox
from parley.streaming import delivery

SF = "/root/testdata/sf0.001"


class Feed:
    """A folder of files that the stream reads one by one."""

    def __init__(self, spark, place):
        self.spark, self.place = spark, place
        self.schema = "meeting_id string, key string, message string, due long, clock long"

    def put(self, rows):
        rows.coalesce(1).write.mode("append").parquet(f"{self.place}/in")

    def tick(self, *times):
        t = self.spark.createDataFrame([(x,) for x in times], "now string").select(F.col("now").cast("timestamp_ntz").alias("now"))
        self.put(delivery.ticks(t, "now"))

    def run(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.place}/in")
        q = delivery.stream_deliveries(source, f"{self.place}/sent", f"{self.place}/state", once=True)
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r.meeting_id, r.key, r.occurrence) for r in delivery.sent_messages(self.spark, f"{self.place}/sent").collect())


@pytest.fixture()
def feed(spark, tmpdir_path):
    return Feed(spark, tmpdir_path)


def _box(spark, rows):
    plans = spark.createDataFrame(rows, "meeting_id string, at string, followup_json string")
    return outbox.build_outbox(plans.select("meeting_id", F.col("at").cast("timestamp_ntz").alias("planned_at"), "followup_json"))


def _due(box, now):
    return sorted((r.meeting_id, r.key, r.occurrence) for r in outbox.due_messages(box, None, F.lit(now).cast("timestamp_ntz")).collect())


def test_each_occurrence_is_sent_once_and_equals_the_batch_query(spark, feed):
    rows = [("a", "2024-03-01 10:00:30", '{"followup_1":"x","followup_2":"y","sales_scoring":{}}'), ("b", "2024-03-02 23:59:10", '{"followup_1":"z"}')]
    box = _box(spark, rows)
    feed.put(delivery.registrations(box))
    feed.tick("2024-03-01 10:00:59")
    assert feed.run() == []
    feed.tick("2024-03-01 10:01:00")  # the minute itself is due
    assert [x[:2] for x in feed.run()] == [("a", "followup_1"), ("a", "followup_2")]
    feed.tick("2024-03-01 10:01:00", "2024-03-01 18:00:00")
    assert len(feed.run()) == 2
    feed.tick("2024-03-05 12:00:00")
    assert feed.run() == _due(box, "2024-03-05 12:00:00")
    feed.tick("2024-03-06 00:00:00")
    feed.tick("2024-03-06 00:00:00")
    got = feed.run()
    assert got == _due(box, "2024-03-06 00:00:00") and len(got) == len(set(got))
    assert got[0][2] == dt.datetime(2024, 3, 1, 10, 1)


def test_late_and_repeated_registrations(spark, feed):
    early, late = _box(spark, [("a", "2024-03-01 10:00:00", '{"followup_1":"x"}')]), _box(spark, [("l", "2024-02-27 08:00:00", '{"followup_1":"y"}')])
    feed.put(delivery.registrations(early))
    feed.tick("2024-03-02 12:00:00")
    feed.put(delivery.registrations(late))  # behind the clock already
    feed.put(delivery.registrations(early))
    feed.tick("2024-03-03 12:00:00")
    assert feed.run() == _due(early.unionByName(late), "2024-03-03 12:00:00")


def test_the_stream_equals_the_batch_query_on_the_fixture(spark, feed):
    m = fx.meetings_json(spark, SF).dropDuplicates(["id"])
    box = outbox.build_outbox(m.select(F.col("id").alias("meeting_id"), F.col("meeting_ts").alias("planned_at"), "followup_json")).persist()
    feed.put(delivery.registrations(box))
    now = str(box.agg(F.max("registered_at")).first()[0])
    feed.tick("2024-01-10 00:00:00")
    feed.tick(now)
    assert os.path.isdir(f"{feed.place}/in") and feed.run() == _due(box, now)


def test_one_timer_waits_for_a_group_of_messages(spark, feed):
    box = _box(spark, [(f"m{i}", f"2024-03-0{1 + i % 3} 1{i % 10}:{i % 60:02}:00", '{"followup_1":"x"}') for i in range(300)]).persist()
    feed.put(delivery.registrations(box))
    feed.tick("2024-03-02 15:00:00")
    feed.tick("2024-03-09 11:30:00")
    source = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{feed.place}/in")
    q = delivery.stream_deliveries(source, f"{feed.place}/sent", f"{feed.place}/state", once=True)
    q.awaitTermination()
    states = [s for p in q.recentProgress for s in p["stateOperators"] if s["operatorName"].startswith("transformWithState")]
    timers = [s["customMetrics"]["numRegisteredTimers"] for s in states]
    assert 0 < max(timers) <= delivery.PARTS < 300
    got = feed.run()
    assert got == _due(box, "2024-03-09 11:30:00") and len(got) == len(set(got))


def test_many_messages_of_one_minute_pass_in_parts(spark, feed, monkeypatch):
    """More messages than an entry of the state and a frame hold, an earlier
    first day than the one waited for, and one behind the clock."""
    rows = {n: [(f"{n}{i}", f"2024-03-{day} 10:00:00", '{"followup_1":"x"}') for i in range(size)]
            for n, day, size in (("a", "03", 23), ("b", "01", 9), ("c", "02", 8), ("d", "28", 5))}
    _small(monkeypatch)
    box = {n: _box(spark, r) for n, r in rows.items()}
    feed.put(delivery.registrations(box["a"]))
    feed.put(delivery.registrations(box["b"]))  # due before what is waited for
    feed.tick("2024-03-02 11:00:00")
    feed.put(delivery.registrations(box["c"]))
    assert feed.run() == _due(box["b"].unionByName(box["c"]), "2024-03-02 11:00:00")
    feed.put(delivery.registrations(box["d"]))
    feed.put(delivery.registrations(_box(spark, [("late", "2024-02-28 10:00:00", '{"followup_1":"x"}')])))
    feed.tick("2024-03-05 10:00:00")
    feed.tick("2024-03-05 10:01:00")
    want = box["a"].unionByName(box["b"]).unionByName(box["c"]).unionByName(_box(spark, [("late", "2024-02-28 10:00:00", '{"followup_1":"x"}')]))
    got = feed.run()
    assert got == _due(want, "2024-03-05 10:01:00") and len(got) == len(set(got))


def _small(monkeypatch):
    """Two groups, entries of 4 messages and frames of 3 rows, also in the workers."""
    stream = delivery.stream_deliveries
    monkeypatch.setattr(delivery, "DailyMessages", lambda make=delivery.DailyMessages: make(chunk=4, frame=3))
    monkeypatch.setattr(delivery, "stream_deliveries", lambda *a, **k: stream(*a, parts=2, **k))


def test_messages_without_a_meeting_or_a_text(spark, feed):
    box = _box(spark, [("a", "2024-03-01 10:00:00", '{"followup_1":null,"followup_2":"y"}'), (None, "2024-03-01 10:00:00", '{"followup_1":"x"}')])
    feed.put(delivery.registrations(box))
    feed.tick("2024-03-02 12:00:00")
    assert feed.run() == _due(box.filter("meeting_id IS NOT NULL"), "2024-03-02 12:00:00")
    sent = delivery.sent_messages(spark, f"{feed.place}/sent").select("key", "message").distinct().collect()
    assert sorted(map(tuple, sent), key=str) == sorted(map(tuple, box.filter("meeting_id IS NOT NULL").select("key", "message").collect()), key=str)
