"""SURVEY §5 edge cases: null JSON, equal timestamps, no scores, CRLF."""

import datetime as dt

from parley.operators import rules, scoring

D = dt.datetime(2024, 5, 1, 10, 0, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, sales_id string, meeting_ts timestamp_ntz, scoring_json string")


def test_null_scoring_json_still_counts_in_weight(spark):
    # newest meeting has NULL scoring: weights 1.0 (null) + 0.8 (clarity 8) -> 8*0.8/1.8 = 3.56
    rows = [("m2", "a", D + dt.timedelta(days=1), None), ("m1", "a", D, '{"clarity": 8}')]
    out = {r.metric: r.weighted_score for r in scoring.weighted_scores(frame(spark, rows)).collect()}
    assert out == {"clarity": 3.56}


def test_equal_timestamps_break_ties_by_id(spark):
    # same time: id "b" counts as newer than "a" (weight 1.0 vs 0.8)
    rows = [("a", "x", D, '{"c": 10}'), ("b", "x", D, '{"c": 0}')]
    out = {r.metric: r.weighted_score for r in scoring.weighted_scores(frame(spark, rows)).collect()}
    assert out == {"c": round(8 / 1.8, 2)}


def test_no_scores_anywhere(spark):
    rows = [("a", "x", D, "{}"), ("b", "y", D, "not json")]
    m = frame(spark, rows)
    assert scoring.best_worst_global(m).count() == 0
    assert scoring.metric_means(m).count() == 0
    prof = {r.sales_id: r for r in scoring.agent_profile(m).collect()}
    assert prof["x"].meeting_count == 1 and prof["x"].best_metric is None


def test_non_numeric_score_is_dropped(spark):
    rows = [("a", "x", D, '{"c": "high", "d": " 7.5 ", "e": null}')]
    out = {r.metric: r.weighted_score for r in scoring.weighted_scores(frame(spark, rows)).collect()}
    assert out == {"d": 7.5}


def test_crlf_text_rules(spark):
    text = "0:04 - يارب سترك\r\nسعر\r\n"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    r = rules.classify_transcripts(df).first()
    assert r.client_name == rules.CLIENT_MARKER_NAME and r.objection == "money"
