import datetime as dt
import json

from parley.operators import scoring


def meetings_df(spark, rows):
    """rows: (id, sales_id, day, scoring dict or raw text)."""
    data = []
    for mid, sid, day, sc in rows:
        text = sc if isinstance(sc, str) else json.dumps(sc)
        data.append((mid, sid, dt.datetime(2024, 5, day, 10, 0, 0), text))
    return spark.createDataFrame(data, "id string, sales_id string, meeting_ts timestamp_ntz, scoring_json string")


def ws(spark, rows):
    out = scoring.weighted_scores(meetings_df(spark, rows)).collect()
    return {r.metric: r.weighted_score for r in out}


def test_weighted_golden(spark):
    rows = [("m3", "a", 9, {"clarity": 8, "rapport": 6}), ("m2", "a", 5, {"clarity": 4}), ("m1", "a", 1, {})]
    assert ws(spark, rows) == {"clarity": 4.67, "rapport": 2.5}


def test_weighted_tail_weight(spark):
    rows = [(f"m{i}", "a", 20 - i, {"clarity": 10} if i == 5 else {}) for i in range(7)]
    # newest first: i=0..6; the sixth newest (i=5) carries weight 0.1
    assert ws(spark, rows) == {"clarity": 0.31}


def test_weighted_text_value_and_empty(spark):
    assert ws(spark, [("m1", "a", 1, {"clarity": "7"})]) == {"clarity": 7.0}
    assert ws(spark, [("m1", "a", 1, {})]) == {}


def test_duplicate_keys_last_wins(spark):
    assert ws(spark, [("m1", "a", 1, '{"clarity": 2, "clarity": 9}')]) == {"clarity": 9.0}


def test_band_thresholds(spark):
    from pyspark.sql import functions as F
    from parley.functions.numeric import score_band
    df = spark.createDataFrame([(7.5,), (7.49,), (5.0,), (4.99,)], "s double")
    assert [r.b for r in df.select(score_band(F.col("s")).alias("b")).collect()] == ["green", "amber", "amber", "red"]


def test_tie_rules_agent_vs_global(spark):
    rows = [("m1", "a", 1, {"rapport": 7, "clarity": 7})]
    m = meetings_df(spark, rows)
    bw = scoring.best_worst_by_agent(m).first()
    assert (bw.best_metric, bw.worst_metric) == ("rapport", "rapport")
    g = scoring.best_worst_global(m).first()
    assert (g.best_metric, g.worst_metric) == ("clarity", "clarity")
    assert "**Clarity** scoring **7.0/10**" in g.summary_text


def test_meeting_span_publishes_both_ends(spark):
    rows = [("m1", "a", 1, {}), ("m2", "a", 5, {}), ("m3", "a", 9, {})]
    r = scoring.meeting_span(meetings_df(spark, rows)).first()
    assert r.first_meeting.startswith("2024-05-01") and r.last_meeting.startswith("2024-05-09")
    assert r.meeting_count == 3


def test_half_up_rounding(spark):
    # 3 meetings, weights 1.0/0.8/0.6: (0.3*1.0)/2.4 = 0.125 -> 0.13 (half up)
    rows = [("m3", "a", 9, {"c": 0.3}), ("m2", "a", 5, {}), ("m1", "a", 1, {})]
    assert ws(spark, rows) == {"c": 0.13}


def test_latest_scores_top5(spark):
    rows = [(f"m{i}", "a", i + 1, {"c": i}) for i in range(8)]
    got = scoring.latest_scores(meetings_df(spark, rows)).collect()
    assert sorted(r.id for r in got) == ["m3", "m4", "m5", "m6", "m7"]


def test_rounding_does_not_overflow_for_huge_sums(spark):
    from pyspark.sql import functions as F
    from parley.functions.numeric import round_ratio_half_up
    df = spark.createDataFrame([(3 * 10**17 + 5 * 10**15, 10**17), (-125, 1000)], "num long, den long")
    got = [r.r for r in df.select(round_ratio_half_up(F.col("num"), F.col("den")).alias("r")).collect()]
    assert got == [3.05, -0.13]
