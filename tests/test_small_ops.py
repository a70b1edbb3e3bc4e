import json
import os

from pyspark.sql import functions as F

from parley.operators import scoring
from parley.sources import transcripts as tsrc


def test_resolve_and_report_json(spark):
    df = spark.createDataFrame([("file", "pasted"), (None, "pasted")], "f string, p string")
    assert [r.t for r in df.select(tsrc.resolve_transcript(F.col("f"), F.col("p")).alias("t")).collect()] == \
        ["file", "pasted"]
    j = tsrc.to_report_json(spark.createDataFrame([("عميل", 1)], "name string, n int")).first().json
    assert json.loads(j) == {"name": "عميل", "n": 1} and "عميل" in j


def test_meetings_table_created_once(spark, tmpdir_path):
    loc = os.path.join(tmpdir_path, "meetings")
    tsrc.ensure_meetings_table(spark, "parley_test_meetings", loc)
    tsrc.ensure_meetings_table(spark, "parley_test_meetings", loc)
    cols = [f.name for f in spark.table("parley_test_meetings").schema.fields]
    assert cols == ["id", "sales_id", "meeting_ts", "analysis_json", "pdfs_json", "followup_json", "scoring_json"]
    spark.sql("DROP TABLE parley_test_meetings")


def test_dashboards_agree_with_single_queries(spark):
    from parley import fixtures as fx
    from parley.plans import dashboards
    m = fx.meetings_json(spark, "/root/testdata/sf0.001")
    g = dashboards.global_dashboard(m)
    assert sorted(map(tuple, g["means"].collect())) == sorted(map(tuple, scoring.metric_means(m).collect()))
    assert g["best_worst"].collect() == scoring.best_worst_global(m).collect()
    wide = dashboards.global_dashboard(m, fx.FIXTURE_METRICS)["matrix"]
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, scoring.score_matrix(m, fx.FIXTURE_METRICS).collect()))
    maps = {(r.sales_id, r.meeting_id): r.scores for r in g["matrix"].collect()}
    for r in wide.collect():
        assert maps[r.sales_id, r.meeting_id] == {k: r[k] for k in fx.FIXTURE_METRICS if r[k] is not None}
    a = dashboards.agent_dashboard(m)
    assert a["profile"].count() == scoring.agent_profile(m).count()
    assert a["heatmap"].count() == a["latest"].select("sales_id", "id").distinct().count()


def test_agent_filter_and_objection(spark):
    import datetime as dt
    from parley.operators import meetings
    rows = [("m1", "a", dt.datetime(2024, 5, 1), '{"objection":"price","topics":["t"]}', "[]", "{}", "{}"),
            ("m2", "b", dt.datetime(2024, 5, 2), '{"objection":""}', "[]", "{}", "{}")]
    m = spark.createDataFrame(rows, "id string, sales_id string, meeting_ts timestamp_ntz, analysis_json string, "
                                    "pdfs_json string, followup_json string, scoring_json string")
    assert [r.id for r in scoring.agent_meetings(m, "b").collect()] == ["m2"]
    d, _ = meetings.decode_meetings(m)
    assert [(r.id, r.objection) for r in meetings.meeting_objection(d).collect()] == [("m1", "price")]


def test_recency_weights_per_meeting(spark):
    import datetime as dt
    rows = [(f"m{i}", "a", dt.datetime(2024, 5, 1 + i), "{}") for i in range(7)] + \
        [("z", "b", dt.datetime(2024, 5, 1), "{}")]
    m = spark.createDataFrame(rows, "id string, sales_id string, meeting_ts timestamp_ntz, scoring_json string")
    got = {r.id: r.weight_x10 for r in scoring.recency_weights(m).collect()}
    assert [got[f"m{i}"] for i in range(6, -1, -1)] == [10, 8, 6, 4, 2, 1, 1] and got["z"] == 10


def test_model_calls_overlap_and_keep_order(spark):
    from parley.operators import inference

    def make():
        import time as _t

        def infer(p):
            _t.sleep(0.01)
            if p == "boom":
                raise RuntimeError("x")
            return '{"echo": "' + p + '"}'
        return infer

    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)] + [(99, "boom")], "k int, prompt string")
    out = inference.apply_model(df.repartition(2), "k", make(), concurrency=4).collect()
    got = {r.k: r.reply for r in out}
    assert {r.k: r.error for r in out}[99] == "call failed: RuntimeError: x"
    assert got[99] is None and all(got[i] == '{"echo": "p%d"}' % i for i in range(40))


def test_dealt_follows_the_setting(spark):
    from parley.session import dealt
    df = spark.range(100).coalesce(1)
    n = spark.conf.get("spark.parley.textPartitions")
    assert dealt(df).rdd.getNumPartitions() == int(n)
    spark.conf.unset("spark.parley.textPartitions")
    try:
        assert dealt(df) is df
    finally:
        spark.conf.set("spark.parley.textPartitions", n)


def test_positions_follow_the_order(spark):
    from parley.operators.ordering import positioned
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)] + [(None, 0)], "a int, b int")
    got = positioned(df.repartition(5), [("b", True), ("a", False)]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 103))
    assert [(r.b, r.a) for r in got] == sorted(((r.b, r.a) for r in got), key=lambda x: (x[0], x[1] is None, -(x[1] or 0)))
    assert positioned(df.limit(0), [("a", True)]).count() == 0


def test_cli_lists_every_query(capsys):
    from parley.__main__ import main
    from parley.plans.queries import QUERIES
    assert main(["list"]) == 0
    assert capsys.readouterr().out.split() == list(QUERIES)
