"""Weighted scores and per-agent best and worst, checked exactly: golden rows
worked by hand, and on the driver's meetings a rational-number computation over
recency ranks taken from DuckDB (no floats, no running totals)."""

import datetime as dt
from fractions import Fraction

import duckdb
import pytest

from parley import fixtures as fx
from parley.operators import scoring

SF = "/root/testdata/sf0.001"
COLUMNS = "id string, sales_id string, meeting_ts timestamp_ntz, scoring_json string"


def half_up(x: Fraction) -> float:
    """Two places; a tie moves away from zero."""
    cents = abs(x) * 100
    whole = cents.numerator // cents.denominator
    whole += cents - whole >= Fraction(1, 2)
    return float(Fraction(whole if x >= 0 else -whole, 100))


@pytest.mark.parametrize("texts,want", [
    # newest first; weights 10 8 6 4 2 and then 1, over the sum of all
    (['{"a":10}', "{}"], {"a": half_up(Fraction(100, 18))}),
    (['{"a":7.12499996}'], {"a": 7.12}),
    (['{"a":7.125}'], {"a": 7.13}),
    (['{"a":true,"b":"7"}'], {"a": 1.0, "b": 7.0}),
    (['{"a":1e0,"b":"inf","c":1e30,"d":"x","e":null,"f":"nan"}'], {"a": 1.0}),
    (["{}"] * 5 + ['{"a":31}', "{}"], {"a": 0.97}),  # 31 * 1 / (30 + 1 + 1) = 0.96875
])
def test_golden_rows(spark, texts, want):
    rows = [(f"m{i}", "x", dt.datetime(2024, 5, 28 - i), t) for i, t in enumerate(texts)]
    got = {r.metric: r.weighted_score for r in scoring.weighted_scores(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == want


def test_rejected_scores_name_the_reason(spark):
    text = '{"a":1,"b":"inf","c":1e30,"d":"x","e":null,"f":"nan","g":true}'
    m = spark.createDataFrame([("m", "x", dt.datetime(2024, 5, 1), text)], COLUMNS)
    got = {r.metric: r.reason for r in scoring.rejected_scores(m).collect()}
    assert got == {"b": "not finite", "c": "out of range", "d": "not a number", "e": "null", "f": "not finite"}
    assert {r.metric for r in scoring.scores_long(m).collect()} == {"a", "g"}
    with pytest.raises(Exception, match="score is not a number"):
        scoring.scores_long(m, strict=True).collect()


def exact_scores(spark):
    """(agent, metric) -> exact weighted mean, and the recency rank at which
    an agent's metric first appears."""
    meetings = fx.meetings_json(spark, SF).select("id", "sales_id", "meeting_ts", "scoring_json").toArrow()  # noqa: F841 - read by the SQL
    rows = duckdb.sql("""
        with m as (select *, row_number() over (partition by sales_id order by meeting_ts desc, id desc) as rank
                   from meetings),
        k as (select *, unnest(json_keys(scoring_json)) as metric from m)
        select sales_id, metric, list(rank) as ranks, list(json_extract_string(scoring_json, '$."' || metric || '"')) as texts,
               (select max(rank) from m n where n.sales_id = k.sales_id) as total
        from k group by sales_id, metric""").fetchall()
    scale = {1: 10, 2: 8, 3: 6, 4: 4, 5: 2}
    out = {}
    for agent, metric, ranks, texts, total in rows:
        weight = sum(scale.get(r, 1) for r in range(1, total + 1))
        out[agent, metric] = (sum(Fraction(t) * scale.get(r, 1) for r, t in zip(ranks, texts)) / weight, min(ranks))
    return out


def test_scores_equal_rational_arithmetic(spark):
    want = {k: half_up(x) for k, (x, _) in exact_scores(spark).items()}
    got = {(r.sales_id, r.metric): r.weighted_score for r in scoring.weighted_scores(fx.meetings_json(spark, SF)).collect()}
    assert got == want


def test_best_and_worst_take_the_metric_seen_first(spark):
    exact = exact_scores(spark)
    for r in scoring.agent_profile(fx.meetings_json(spark, SF)).collect():
        mine = {m: (half_up(x), first) for (a, m), (x, first) in exact.items() if a == r.sales_id}
        if not mine:
            assert r.best_metric is None and r.worst_metric is None
            continue
        top, low = max(s for s, _ in mine.values()), min(s for s, _ in mine.values())
        assert (r.best_score, r.worst_score) == (top, low)
        # Among equals the earliest rank wins; the score objects list metrics in text order.
        assert r.best_metric == min((f, m) for m, (s, f) in mine.items() if s == top)[1]
        assert r.worst_metric == min((f, m) for m, (s, f) in mine.items() if s == low)[1]
