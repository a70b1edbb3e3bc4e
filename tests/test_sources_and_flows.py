import datetime as dt
import json
import os

from pyspark.sql import functions as F

from parley import fixtures as fx
from parley.operators import inference, meetings
from parley.plans import flows
from parley.sources import corpus as csrc
from parley.sources import transcripts as tsrc


def test_catalog_case_rules(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "Marketing")
    os.makedirs(d)
    for n in ("A.PDF", "b.pdf", "c.txt"):
        open(os.path.join(d, n), "wb").write(b"x")
    names = sorted(r.name for r in csrc.catalog(spark, tmpdir_path).collect())
    assert names == ["A.PDF", "b.pdf"]
    os.makedirs(os.path.join(d, "old"))
    open(os.path.join(d, "old", "nested.pdf"), "wb").write(b"x")  # not a direct child of the sector
    assert sorted(r.name for r in csrc.catalog(spark, tmpdir_path).collect()) == ["A.PDF", "b.pdf"]
    exact = csrc.catalog(spark, tmpdir_path, ignore_case=False).collect()
    assert [(r.sector, r.name) for r in exact] == [("Marketing", "b.pdf")]
    assert csrc.catalog(spark, os.path.join(tmpdir_path, "missing")).count() == 0


def test_json_corpus_and_cache_build(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cache.json")
    json.dump({"b.pdf": "second", "a.pdf": "first"}, open(p, "w"), ensure_ascii=False)
    rows = csrc.load_json_corpus(spark, p, "Marketing").orderBy("ordinal").collect()
    assert [(r.name, r.ordinal, r.text) for r in rows] == [("b.pdf", 0, "second"), ("a.pdf", 1, "first")]
    assert csrc.load_json_corpus(spark, os.path.join(tmpdir_path, "none.json")).count() == 0
    twice = os.path.join(tmpdir_path, "twice.json")
    open(twice, "w").write('{"a.pdf":"old","b.pdf":"b","a.pdf":"new"}')
    assert {r.name: r.text for r in csrc.load_json_corpus(spark, twice).collect()} == {"a.pdf": "new", "b.pdf": "b"}
    half = os.path.join(tmpdir_path, "half")  # a writer that died left no _SUCCESS
    os.makedirs(os.path.join(half, "_temporary", "0"))
    assert csrc.load_corpus(spark, half).count() == 0
    cache = os.path.join(tmpdir_path, "corpus")
    calls = []

    def build():
        calls.append(1)
        return csrc.build_corpus(csrc.pages_as_files(fx.table(spark, "/root/testdata/sf0.001", "pages")))

    first = csrc.load_or_build_corpus(spark, cache, build)
    again = csrc.load_or_build_corpus(spark, cache, build)
    assert len(calls) == 1
    key = ["sector", "name", "path", "text"]
    assert sorted(map(tuple, first.select(*key).collect())) == sorted(map(tuple, build().select(*key).collect()))
    assert again.count() == first.count()


def test_extraction_fallback(spark):
    html = ['<script>var t="</p>";</script><p>Hello <b>world</b></p><p>again</p>',
            '<div>only div</div>', None]
    df = spark.createDataFrame([(h,) for h in html], "html string")
    got = [r.t for r in df.select(csrc.extract_with_fallback(csrc.paragraph_text("html"),
                                                             csrc.all_text("html")).alias("t")).collect()]
    assert got[0] == "Hello world\nagain"
    assert got[1].strip() == "only div"
    assert got[2] == ""


def test_read_transcripts_binary_drops_bad_bytes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "m1.txt")
    open(p, "wb").write("سعر".encode() + b"\xff\xfe" + b" ok")
    r = tsrc.read_transcripts(spark, p, binary=True).first()
    assert r.meeting_id == "m1" and r.text == (b"\xd8\xb3\xd8\xb9\xd8\xb1\xff\xfe ok").decode("utf-8", "ignore")
    t = tsrc.read_transcripts(spark, p).first()
    assert t.meeting_id == "m1"


def test_equal_file_names_in_two_folders_keep_two_ids(spark, tmpdir_path):
    for d in ("x", "y"):
        os.makedirs(os.path.join(tmpdir_path, d))
        open(os.path.join(tmpdir_path, d, "m.txt"), "w").write(d)
    for binary in (False, True):
        got = {r.meeting_id: r.text for r in tsrc.read_transcripts(spark, tmpdir_path, binary).collect()}
        assert got == {"x/m": "x", "y/m": "y"}


def test_load_meetings_newest_first(spark, tmpdir_path):
    loc = os.path.join(tmpdir_path, "stored")
    fx.meetings_json(spark, "/root/testdata/sf0.001").write.parquet(loc)
    rows = tsrc.load_meetings(spark, loc).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert all(a.meeting_ts >= b.meeting_ts for a, b in zip(rows, rows[1:]))


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame(
        [("m", "a", dt.datetime(2024, 5, 1), ["t1"], "عميل", "money", "s", [("x.pdf", "d")],
          {"followup_1": "hi", "sales_scoring": '{"c":7}'})],
        "id string, sales_id string, meeting_ts timestamp_ntz, topics array<string>, fears string, "
        "objection string, summary string, pdfs array<struct<name:string,description:string>>, "
        "followup map<string,string>")
    df = df.select("id", "sales_id", "meeting_ts",
                   F.struct("topics", "fears", "objection", "summary").alias("analysis"),
                   F.transform("pdfs", lambda p: F.array(p["name"], p["description"])).alias("pdfs"),
                   "followup")
    enc = meetings.encode_meeting(df)
    r = enc.first()
    assert "عميل" in r.analysis_json
    d, rej = meetings.decode_meetings(enc)
    assert rej.count() == 0
    row = d.first()
    assert row.analysis.fears == "عميل" and row.pdfs[0].name == "x.pdf"


def make_fake_model():
    # Built inside a function so it is shipped to the workers by value.
    import json as _json

    def fake(prompt: str) -> str:
        good = {"topics": ["that with", "the and"], "fears": "f", "objection": "price", "summary": "s", "clarity": "kept"}
        if "استخرج" in prompt:
            if "broken" in prompt:
                return "not json"
            if "cut off" in prompt:
                return _json.dumps(good)[:-20]
            if "no fears" in prompt:
                del good["fears"]
            if "unplanned" in prompt:
                good["summary"] = "unplanned"
            return _json.dumps(good)
        if "unplanned" in prompt:
            raise RuntimeError("busy")
        return _json.dumps({"followup_1": {"subject": "s1", "body": "b1"},
                            "sales_scoring": {"clarity": 8, "rapport": "7"}})
    return fake


def test_model_flow_with_callable_and_ingest(spark):
    _fake_model = make_fake_model()
    t = fx.transcripts(spark, "/root/testdata/sf0.001").orderBy("conv_id").limit(3) \
        .withColumn("conv_id", F.col("conv_id").cast("string"))
    bad = spark.createDataFrame([("96", "unplanned"), ("97", "no fears"), ("98", "cut off"), ("99", "broken text")],
                                "conv_id string, text string")
    t = t.unionByName(bad)
    corpus = csrc.build_corpus(csrc.pages_as_files(fx.table(spark, "/root/testdata/sf0.001", "pages")))  # no ordinal
    run = flows.model_flow(t, corpus, "conv_id", analyze=_fake_model, plan=_fake_model)
    assert run["analysis"].count() == 4
    assert run["documents"].filter(F.col("rank") == 1).count() == 4
    assert run["plans"].count() == 3
    rejects = {(r.conv_id, r.stage): r.reason for r in run["rejected"].collect()}
    assert rejects == {("96", "plan"): "call failed: RuntimeError: busy", ("97", "analysis"): "missing field: fears",
                       ("98", "analysis"): "not a JSON object", ("99", "analysis"): "not a JSON object"}
    agents = t.select("conv_id", F.lit("A1").alias("sales_id"),
                      (F.lit(dt.datetime(2024, 5, 1)).cast("timestamp_ntz")
                       + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("conv_id").cast("int")))
                      .alias("meeting_ts"))
    empty = spark.createDataFrame([], "id string")
    saved, _, failed = flows.ingest(empty, t, agents, corpus, "conv_id", analyze=_fake_model, plan=_fake_model)
    rows = saved.collect()
    # No row for a failed plan, and the whole analysis object is stored.
    assert len(rows) == 3 and all(json.loads(r.scoring_json)["clarity"] == 8 for r in rows)
    assert all(json.loads(r.analysis_json)["clarity"] == "kept" for r in rows)
    assert failed.count() == 4


def test_plan_request_prints_lists_as_python_does(spark):
    topics = [["a", "it's", 'say "hi"', 'both \' and "', "back\\slash", "line\nbreak", "سعر"], [], None]
    df = spark.createDataFrame([(t,) for t in topics[:2]], "t array<string>")
    assert [r.p for r in df.select(inference.python_list_text(F.col("t")).alias("p")).collect()] == [str(t) for t in topics[:2]]


def test_offline_analysis_shape(spark):
    t = fx.transcripts(spark, "/root/testdata/sf0.001").limit(5)
    a = inference.analyze_transcripts(t, "conv_id", None, fx.fixture_words()).collect()
    assert len(a) == 5 and all(len(r.analysis.topics) <= 3 and r.analysis.summary.endswith("...") for r in a)
