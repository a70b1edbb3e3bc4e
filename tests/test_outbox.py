import datetime as dt

from pyspark.sql import functions as F

from parley.operators import outbox


def test_build_outbox_and_daily_slot(spark):
    now = dt.datetime(2024, 5, 1, 10, 0, 30)
    plans = spark.createDataFrame([("m", now, '{"followup_1":"hi","sales_scoring":{"c":1}}')],
                                  "meeting_id string, planned_at timestamp_ntz, followup_json string")
    box = outbox.build_outbox(plans)
    r = box.first()
    assert (r.key, r.message, r.send_at_text, r.slot) == ("followup_1", "hi", "2024-05-01 10:01:30", "10:01")
    assert outbox.build_outbox(plans, all_keys=True).count() == 2
    later = F.lit(dt.datetime(2024, 5, 3, 12, 0, 0)).cast("timestamp_ntz")
    due = [r.occurrence for r in outbox.due_messages(box, None, later).orderBy("occurrence").collect()]
    assert due == [dt.datetime(2024, 5, d, 10, 1) for d in (1, 2, 3)]
    sent = spark.createDataFrame([("m", "followup_1", dt.datetime(2024, 5, 1, 10, 1))],
                                 "meeting_id string, key string, occurrence timestamp_ntz")
    assert outbox.due_messages(box, sent, later).count() == 2
    assert outbox.due_messages(box, None, later, recurring=False).count() == 1


def test_incremental_runs_add_up_to_the_full_history(spark):
    plans = spark.createDataFrame(
        [("m1", dt.datetime(2024, 5, 1, 10, 0, 30), '{"followup_1":"a"}'),
         ("m2", dt.datetime(2024, 5, 1, 23, 59, 30), '{"followup_1":"b","followup_2":"c"}'),
         ("m3", dt.datetime(2024, 5, 4, 8, 0, 0), '{"followup_1":"d"}')],
        "meeting_id string, planned_at timestamp_ntz, followup_json string")
    box = outbox.build_outbox(plans)
    ts = [dt.datetime(2024, 5, 2, 0, 0, 30), dt.datetime(2024, 5, 3, 12, 0), dt.datetime(2024, 5, 6, 10, 1),
          dt.datetime(2024, 5, 9, 0, 0)]

    def lit(x):
        return F.lit(x).cast("timestamp_ntz")

    full = sorted(map(tuple, outbox.due_messages(box, None, lit(ts[-1])).collect()))
    parts, prev = [], None
    for t in ts:
        parts += outbox.due_messages(box, None, lit(t), since=None if prev is None else lit(prev)).collect()
        prev = t
    assert sorted(map(tuple, parts)) == full and len(full) > 10
