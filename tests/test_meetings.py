import datetime as dt

from pyspark.sql import functions as F

from parley.operators import meetings


def stored(spark, rows):
    return spark.createDataFrame(rows, "id string, sales_id string, meeting_ts timestamp_ntz, analysis_json string, "
                                       "pdfs_json string, followup_json string, scoring_json string")


T0 = dt.datetime(2024, 5, 1, 10, 0, 0, 100)
T1 = dt.datetime(2024, 5, 1, 10, 0, 0, 900)


def test_save_same_second_first_wins_and_resave_is_noop(spark):
    new = spark.createDataFrame([("a", T1), ("b", T0)], "sales_id string, meeting_ts timestamp_ntz")
    new = meetings.stamp_meetings(new)
    empty = spark.createDataFrame([], "id string")
    saved, rejected = meetings.save_meetings(empty, new)
    s = saved.collect()
    assert [(r.id, r.sales_id) for r in s] == [("20240501-100000", "b")]
    assert [(r.sales_id, r.copies) for r in rejected.collect()] == [("a", 1)]
    again, rej2 = meetings.save_meetings(saved, new)
    assert again.count() == 0 and sorted((r.sales_id, r.copies) for r in rej2.collect()) == [("a", 1), ("b", 1)]


def test_identical_copies_are_counted_not_regenerated(spark):
    rows = [("x", T0)] * 5 + [("y", T1)]
    new = meetings.stamp_meetings(spark.createDataFrame(rows, "sales_id string, meeting_ts timestamp_ntz"))
    saved, rejected = meetings.save_meetings(spark.createDataFrame([], "id string"), new)
    assert [r.sales_id for r in saved.collect()] == ["x"]
    assert sorted((r.sales_id, r.copies) for r in rejected.collect()) == [("x", 4), ("y", 1)]


def test_iso_date_drops_zero_fraction(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 1, 10, 0, 0),), (T0,)], "meeting_ts timestamp_ntz")
    got = [r.meeting_date for r in meetings.stamp_meetings(df).collect()]
    assert got == ["2024-05-01T10:00:00", "2024-05-01T10:00:00.000100"]


def test_followup_cards_order_defaults_and_attachments(spark):
    fu = ('{"followup_2":{"subject":"two"},"sales_scoring":{"c":1},"followup_10":"plain text",'
          '"followup_1":{"body":"b1","attachments":[{}]}}')
    m = stored(spark, [("m", "a", T0, '{"summary":"s"}', "[]", fu, '{"c":1}')])
    d, rej = meetings.decode_meetings(m)
    assert rej.count() == 0
    cards = meetings.followup_cards(d).orderBy("key").collect()
    assert [c.key for c in cards] == ["followup_1", "followup_10", "followup_2"]
    assert cards[0].subject == meetings.DEFAULT_SUBJECT_REPORT and cards[0].body == "b1"
    assert cards[1].body == "plain text"
    assert [c.position for c in cards] == [1, 2, 3]
    att = meetings.followup_attachments(d).collect()
    assert [(a.name, a.description) for a in att] == [("file.pdf", "")]
    assert "<b></b>" in att[0].reason  # a missing subject is empty there
    rep = meetings.meeting_report(d).first()
    assert [f.key for f in rep.followups] == ["followup_1", "followup_10", "followup_2"]
    assert [[(a.name, a.description) for a in f.attachments] for f in rep.followups] == [[("file.pdf", "")], [], []]
    assert rep.mistakes == [meetings.NO_MISTAKES] and rep.missed == [meetings.NO_MISSED]


def test_bad_json_is_rejected_not_raised(spark):
    m = stored(spark, [("m1", "a", T0, "{not json", "[]", "{}", "{}"), ("m2", "a", T1, "{}", "[]", "{}", "{}")])
    d, rej = meetings.decode_meetings(m)
    assert [r.id for r in d.collect()] == ["m2"] and [r.id for r in rej.collect()] == ["m1"]


def test_extract_scoring(spark):
    df = spark.createDataFrame([('{"sales_scoring":{"c":7}}',), ('{"followup_1":"x"}',)], "f string")
    got = [r.s for r in df.select(meetings.extract_scoring(F.col("f")).alias("s")).collect()]
    assert got == ['{"c":7}', "{}"]


def test_repeated_keys_keep_the_last_value_everywhere(spark):
    fu = ('{"followup_1":{"subject":"old"},"wrong_chat_or_action":"text","followup_1":{"subject":"new","body":"b"},'
          '"wrong_chat_or_action":["m1"],"sales_scoring":{"c":1}}')
    m = stored(spark, [("m", "a", T0, '{"summary":"one","summary":"two","fears":null}', "[]", fu, '{"c":1,"c":2}')])
    d, rej = meetings.decode_meetings(m)
    assert rej.count() == 0
    assert [(c.key, c.subject, c.body) for c in meetings.followup_cards(d).collect()] == [("followup_1", "new", "b")]
    assert [r.mistake for r in meetings.mistakes(d).collect()] == ["m1"]
    r = meetings.meeting_report(d).first()
    assert r.summary == "two" and [(s.key, s.value) for s in r.scores] == [("c", "2")] and r.mistakes == ["m1"]


def test_list_fields_keep_plain_texts(spark):
    cases = {'"He was rude"': ["He was rude"], "[]": [meetings.NO_MISTAKES], "null": [meetings.NO_MISTAKES], '""': [meetings.NO_MISTAKES],
             '["a","b"]': ["a", "b"], '{"x":1}': ['{"x":1}']}
    for raw, want in cases.items():
        m = stored(spark, [("m", "a", T0, "{}", "[]", '{"wrong_chat_or_action":%s}' % raw, "{}")])
        d, _ = meetings.decode_meetings(m)
        assert [r.mistake for r in meetings.mistakes(d).orderBy("pos").collect()] == want, raw
        assert meetings.meeting_report(d).first().mistakes == want


def test_encode_pairs_and_nested_plan_values(spark):
    import json
    df = spark.createDataFrame([("m", "a", T0)], "id string, sales_id string, meeting_ts timestamp_ntz").select(
        "*", F.struct(F.lit("s").alias("summary")).alias("analysis"),
        F.array(F.struct(F.lit("x.pdf").alias("name"), F.lit("d").alias("description"))).alias("pdfs"),
        F.create_map(F.lit("followup_1"), F.lit('{"subject":"s","body":"é \\"q\\""}'), F.lit("note"), F.lit('plain "text"'),
                     F.lit("sales_scoring"), F.lit('{"c":7}')).alias("followup"))
    r = meetings.encode_meeting(df).first()
    assert json.loads(r.pdfs_json) == [["x.pdf", "d"]] and json.loads(r.scoring_json) == {"c": 7}
    assert json.loads(r.followup_json) == {"followup_1": {"subject": "s", "body": 'é "q"'}, "note": 'plain "text"', "sales_scoring": {"c": 7}}


def test_label_without_agent(spark):
    m = stored(spark, [("m", None, T0, '{"summary":"s"}', "[]", "{}", "{}")])
    assert " N/A " in meetings.archive(m).first().label
