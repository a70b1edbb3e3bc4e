"""Kept per-agent state against the full computation."""

import os

from pyspark.sql import functions as F

from parley import fixtures as fx
from parley.operators import agent_state, scoring

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _source_scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("events.parquet") + plan.count("LogicalRDD")


def test_state_of_batches_equals_one_computation(spark, tmpdir_path):
    """Varied meetings (repeated keys, texts, ``true``, bad scores) by day."""
    m = fx.meetings_varied(spark, SF)
    whole_cards, whole_profile = _rows(scoring.weighted_score_cards(m)), _rows(scoring.agent_profile(m))
    path = os.path.join(tmpdir_path, "state")
    days = sorted(r.d for r in m.select(F.dayofmonth("meeting_ts").alias("d")).distinct().collect())
    parts = [days[0::3], days[1::3], days[2::3]]
    for i, part in enumerate(parts):
        agent_state.append(m.filter(F.dayofmonth("meeting_ts").isin(part)), path, f"2024-01-{i + 1:02d}")
    assert _rows(agent_state.score_cards(spark, path)) == whole_cards
    assert _rows(agent_state.agent_profile(spark, path)) == whole_profile
    # A batch that is written again replaces itself.
    agent_state.append(m.filter(F.dayofmonth("meeting_ts").isin(parts[1])), path, "2024-01-02")
    assert _rows(agent_state.score_cards(spark, path)) == whole_cards
    # Compacted, the state holds a row per agent and metric and goes on as before.
    folded = os.path.join(tmpdir_path, "folded")
    agent_state.compact(spark, path, folded)
    assert _rows(agent_state.agent_profile(spark, folded)) == whole_profile
    s = agent_state.summary(spark, folded)
    assert s.count() == s.select("sales_id", "metric").distinct().count()
    assert s.filter("size(head) > 5").isEmpty()


def test_order_of_batches_does_not_matter_and_ties_do_not(spark, tmpdir_path):
    rows = [(f"m{i:02d}", "a", f"2024-01-{1 + i % 4:02d} 10:00:00", f'{{"x":{i}.5,"y":{10 - i}}}') for i in range(12)]
    rows += [("n", "b", "2024-01-01 00:00:00", "{}"), ("o", None, "2024-01-01 00:00:00", '{"x":"bad","z":true}')]
    m = spark.createDataFrame(rows, "id string, sales_id string, ts string, scoring_json string").select(
        "id", "sales_id", F.col("ts").cast("timestamp_ntz").alias("meeting_ts"), "scoring_json")
    want = _rows(scoring.agent_profile(m))
    for name, order in (("up", (0, 1, 2)), ("down", (2, 1, 0))):
        path = os.path.join(tmpdir_path, name)
        for k in order:
            agent_state.append(m.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == k), path, f"k{k}")
        assert _rows(agent_state.agent_profile(spark, path)) == want


def test_scores_scan_the_meetings_once(spark):
    """The score rows are written once; what follows reads them only."""
    df = scoring.weighted_score_cards(fx.meetings_json(spark, SF))
    files = {f.rsplit("/", 2)[-2].rsplit("-", 1)[0].split("-")[0] for f in df.inputFiles()}
    assert files == {"score"} and _source_scans(df) == 0
