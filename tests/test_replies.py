"""The reply table: what is sent to the model, and how often."""

import os

import pytest
from pyspark.sql import functions as F

from parley.operators import inference

GOOD = '{"topics": ["t"], "fears": "f", "objection": "o", "summary": "s"}'


def _model(log, replies):
    """A model that notes each request in a file (it runs in other processes)."""
    def infer(prompt):
        with open(os.path.join(log, "calls"), "a", encoding="utf-8") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        for word, reply in replies.items():
            if word in prompt:
                if reply is None:
                    raise RuntimeError("down")
                return reply
        return GOOD
    return infer


def _calls(log):
    path = os.path.join(log, "calls")
    return open(path, encoding="utf-8").read().splitlines() if os.path.exists(path) else []


@pytest.fixture()
def log(tmpdir_path):
    return tmpdir_path


def _prompts(spark, rows):
    return spark.createDataFrame(rows, "k string, prompt string").repartition(3)


def _asked(spark, rows, infer, path, **options):
    got = inference.ask(_prompts(spark, rows), "k", infer, path, "analysis", inference.ANALYSIS_FIELDS, **options)
    return {r.k: (r.reply, r.error) for r in got.collect()}


def test_equal_requests_are_sent_once_and_a_second_run_sends_nothing(spark, log):
    rows = [("a", "same"), ("b", "same"), ("c", "other"), ("d", None)]
    path = os.path.join(log, "replies")
    first = _asked(spark, rows, _model(log, {}), path)
    assert first == {"a": (GOOD, None), "b": (GOOD, None), "c": (GOOD, None), "d": (None, "no prompt")}
    assert sorted(_calls(log)) == ["other", "same"]
    assert _asked(spark, rows, _model(log, {}), path) == first
    assert len(_calls(log)) == 2
    # The same text in another stage is another request.
    inference.ask(_prompts(spark, rows), "k", _model(log, {}), path, "plan").collect()
    assert len(_calls(log)) == 4


def test_bad_replies_are_tried_again_within_the_bound_and_all_tries_are_listed(spark, log):
    rows, path = [("a", "cut"), ("b", "fails"), ("c", "fine"), ("d", "lacks")], os.path.join(log, "replies")
    bad = {"cut": GOOD[:20], "fails": None, "lacks": '{"topics": []}'}
    got = _asked(spark, rows, _model(log, bad), path, attempts=3)
    assert got["c"] == (GOOD, None) and got["a"] == (GOOD[:20], None) and got["b"][1] == "call failed: RuntimeError: down"
    calls = _calls(log)
    assert sorted((c, calls.count(c)) for c in set(calls)) == [("cut", 3), ("fails", 3), ("fine", 1), ("lacks", 3)]
    ledger = {(r.attempt, r.reason) for r in inference.reply_ledger(spark, path, "analysis").collect()}
    assert ledger == {(1, None), *((n, w) for n in (1, 2, 3) for w in ("not a JSON object", "call failed: RuntimeError: down", "missing field: fears"))}
    # The bound is used up; a larger one lets the model answer at last.
    assert _asked(spark, rows, _model(log, {}), path, attempts=3) == got and len(_calls(log)) == 10
    assert set(_asked(spark, rows, _model(log, {}), path, attempts=4).values()) == {(GOOD, None)}
    assert len(_calls(log)) == 13


def test_a_killed_run_goes_on_behind_its_last_wave(spark, log, monkeypatch):
    rows, path = [(f"k{i}", f"request {i}") for i in range(40)], os.path.join(log, "replies")
    send, waves = inference.apply_model, []

    def killed(part, *args, **options):
        waves.append(part.count())
        if len(waves) == 3:
            raise KeyboardInterrupt
        return send(part, *args, **options)

    monkeypatch.setattr(inference, "apply_model", killed)
    with pytest.raises(KeyboardInterrupt):
        _asked(spark, rows, _model(log, {}), path, wave=10)
    done = len(_calls(log))
    assert done == sum(waves[:2]) > 0
    monkeypatch.setattr(inference, "apply_model", send)
    assert set(_asked(spark, rows, _model(log, {}), path, wave=10).values()) == {(GOOD, None)}
    assert len(_calls(log)) == 40 == len(set(_calls(log)))


def test_analyses_and_plans_share_a_reply_table(spark, log):
    t = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, "bad one")], "k int, text string")
    path, model = os.path.join(log, "replies"), _model(log, {"bad": "nonsense"})
    for _ in range(2):
        parsed, rejected = inference.analyze(t, "k", model, replies=path)
        plans, refused = inference.plan_followups(t.select("k", F.col("text").alias("prompt")), "k", model, replies=path)
        assert {r.k for r in parsed.collect()} == {1, 2} and {(r.k, r.stage, r.reason) for r in rejected.collect()} == {(3, "analysis", "not a JSON object")}
        assert {r.k for r in plans.collect()} == {1, 2} and {(r.k, r.stage) for r in refused.collect()} == {(3, "plan")}
    assert len(_calls(log)) == 4
