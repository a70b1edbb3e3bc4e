import glob
import os

import pytest
from pyspark.sql import functions as F

from parley import fixtures as fx
from parley.operators import rules
from parley.streaming import ingest

SF = "/root/testdata/sf0.001"


def _put(folder, files):
    for name, text in files:
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def _ids_and_texts(batch):
    return batch.select("meeting_id", "text")


@pytest.fixture()
def place(tmpdir_path):
    return {k: os.path.join(tmpdir_path, k) for k in ("in", "out", "no", "ckpt")}


def _run(spark, place, source=None, n=1000, build=_ids_and_texts):
    q = ingest.stream_records(ingest.transcript_files(spark, source or place["in"], n), place["out"], place["ckpt"], build, place["no"], once=True)
    q.awaitTermination()
    assert q.exception() is None
    return sorted(tuple(r) for r in ingest.read_records(spark, place["out"]).collect())


def test_stream_equals_batch_and_replay_adds_nothing(spark, place):
    t = fx.transcripts(spark, SF).orderBy("conv_id").limit(12).collect()
    _put(place["in"], [(f"conv{r.conv_id}.txt", r.text) for r in t])
    corpus = fx.corpus(spark, SF)
    cache = corpus.filter(F.col("sector") == "Marketing").select("name", "text", "ordinal")
    words = fx.fixture_words()
    q = ingest.stream_followups(spark, place["in"], place["out"], place["ckpt"], corpus, cache, words, max_files_per_trigger=5)
    q.processAllAvailable()
    q.stop()
    streamed = sorted(tuple(r) for r in ingest.read_records(spark, place["out"]).drop("schedule").collect())
    batch_in = spark.createDataFrame([(f"conv{r.conv_id}.txt", r.text) for r in t], "meeting_id string, text string")
    batch = sorted(tuple(r) for r in ingest.followup_batch(batch_in, corpus, cache, words).drop("schedule").collect())
    assert streamed == batch and len(streamed) == 12
    assert ingest.append_new(spark, ingest.followup_batch(batch_in, corpus, cache, words), place["out"]) == 0


def test_equal_names_in_two_folders_and_of_two_kinds_are_all_stored(spark, place):
    _put(place["in"], [("x/m.txt", "one"), ("y/m.txt", "two"), ("x/m.md", "three"), ("x/m", "four")])
    assert _run(spark, place, source=place["in"] + "/*") == [("x/m", "four"), ("x/m.md", "three"), ("x/m.txt", "one"), ("y/m.txt", "two")]


def test_a_restart_goes_on_and_never_reads_the_table(spark, place):
    _put(place["in"], [(f"a{i}", f"text {i}") for i in range(6)])
    assert len(_run(spark, place, n=2)) == 6
    # A file that no reader can open: a batch that scanned the table would fail.
    broken = os.path.join(place["out"], "stream=broken", "batch=0")
    _put(broken, [("part-0.parquet", "no parquet")])
    _put(place["in"], [("b", "later")])
    q = ingest.stream_records(ingest.transcript_files(spark, place["in"]), place["out"], place["ckpt"], _ids_and_texts, once=True)
    q.awaitTermination()
    assert q.exception() is None
    os.remove(os.path.join(broken, "part-0.parquet"))
    assert len(ingest.read_records(spark, place["out"]).collect()) == 7


def test_a_batch_that_failed_behind_its_write_is_replayed_without_a_trace(spark, place):
    _put(place["in"], [("a", "1"), ("b", "2")])
    first = _run(spark, place)
    last = sorted(glob.glob(place["ckpt"] + "/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))[-1]
    for path in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        os.remove(path)  # written, but not committed
    _put(place["in"], [("c", "3")])
    assert _run(spark, place) == [*first, ("c", "3")]


def test_a_new_checkpoint_knows_the_stored_ids_and_lists_what_it_rejects(spark, place):
    stored = spark.createDataFrame([("a", "old"), ("z", "old")], "meeting_id string, text string")
    assert ingest.append_new(spark, stored, place["out"]) == 2
    _put(place["in"], [("a", "again"), ("b", "new")])
    assert _run(spark, place) == [("a", "old"), ("b", "new"), ("z", "old")]
    assert [tuple(r) for r in ingest.read_records(spark, place["no"]).collect()] == [("a", "again")]
    # A file that is written anew keeps its id.
    _put(place["in"], [("b", "changed")])
    os.utime(os.path.join(place["in"], "b"), (4e9, 4e9))
    assert _run(spark, place) == [("a", "old"), ("b", "new"), ("z", "old")]


def test_blank_texts_are_dropped(spark, place):
    _put(place["in"], [("a", " \n\t"), ("b", "text")])
    got = _run(spark, place, build=lambda b: rules.classify_transcripts(ingest.meetings.valid_transcripts(b)).select("meeting_id", "objection"))
    assert got == [("b", "none")]
