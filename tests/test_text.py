import re

from pyspark.sql import functions as F

from parley.functions import text as tx


def py_clean_text(t):
    t = t.replace("\n", " ").replace("\r", " ")
    return re.sub(r"\s+", " ", t).strip()


def py_summary(t):
    return " ".join(py_clean_text(t).split(" ")[:40]) + "..."


SAMPLES = ["a\r\n\tb\u00a0\x1cc ", "", "   ", "\t\n", "\u00a0", "x  y   z", "one two",
           " ".join(f"w{i}" for i in range(41)), "emoji 😀  here\u2028there\u3000end", "a\x0bb\x1fc\x85d"]


def one_col(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_clean_text_matches_python(spark):
    rows = one_col(spark, SAMPLES).select("t", tx.clean_text("t").alias("c"), tx.summarize("t").alias("s"),
                                          tx.strip("t").alias("st")).collect()
    for r in rows:
        assert r.c == py_clean_text(r.t), repr(r.t)
        assert r.s == py_summary(r.t), repr(r.t)
        assert r.st == r.t.strip(), repr(r.t)


def test_clean_text_on_driver_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rows = d.select("text", tx.clean_text(tx.head_chars("text", 2000)).alias("c")).collect()
    for r in rows:
        assert r.c == py_clean_text(r.text[:2000])


def test_golden_text_rows(spark):
    r = one_col(spark, ["a   b    c"]).select(tx.clean_extracted("t").alias("x")).first()
    assert r.x == "a  b  c"
    r = one_col(spark, [""]).select(tx.summarize("t").alias("x")).first()
    assert r.x == "..."
    r = one_col(spark, ["one two three"]).select(tx.summarize("t").alias("x")).first()
    assert r.x == "one two three..."
    s60, s61 = "x" * 60, "y" * 61
    got = one_col(spark, [s60, s61]).select(tx.snippet("t").alias("x")).collect()
    assert [g.x for g in got] == [s60, "y" * 60 + "..."]


def test_labels_and_names(spark):
    df = spark.createDataFrame([("need_understanding", "E:\\dir\\A.pdf"), ("closing_power", "a/b/x.PDF.pdf")],
                               "m string, p string")
    got = df.select(tx.metric_label("m").alias("l"), tx.base_name("p").alias("b"),
                    tx.document_stem(tx.base_name("p")).alias("s")).collect()
    assert [g.l for g in got] == ["Need Understanding", "Closing Power"]
    assert [g.b for g in got] == ["A.pdf", "x.PDF.pdf"]
    assert [g.s for g in got] == ["a", "x.pdf"]


def test_valid_transcripts_rejects_blank(spark):
    from parley.operators.meetings import valid_transcripts
    df = one_col(spark, ["", "   ", "\t\n", "\u00a0", "ok"]).withColumnRenamed("t", "text")
    assert [r.text for r in valid_transcripts(df).collect()] == ["ok"]


def test_meeting_key_md5(spark):
    import hashlib
    df = spark.createDataFrame([("20240101-000007",)], "id string")
    got = df.select(tx.meeting_key(F.col("id"), F.lit("x")).alias("k")).first().k
    assert got == "radar_" + hashlib.md5(b"20240101-000007").hexdigest()


def test_spark_lower_equals_python_lower_on_driver_texts(spark):
    """The rules lower-case with Spark (JVM) where the original used
    Python; check the two agree on every driver text."""
    from parley import fixtures as fx
    sf = "/root/testdata/sf0.01"
    texts = [fx.transcripts(spark, sf).select("text"),
             fx.table(spark, sf, "documents").select("text"),
             fx.table(spark, sf, "pages").select(F.col("html").alias("text"))]
    for df in texts:
        for r in df.select("text", F.lower("text").alias("l")).collect():
            if r.text is not None:
                assert r.l == r.text.lower()
