from pyspark.sql import functions as F

from parley.operators import rules

# Short Arabic rows with the keywords of the reference's sample meeting:
# price and budget (money), results and time, a campaign, sales, a client;
# the ad word is spelt with a hamza so it must not match the lexicon's form.
SAMPLE = ("اجتماع حول إعلان جديد\n"
          "العميل يريد نتائج سريعة في وقت قصير\n"
          "ميزانية الحملة محدودة\n"
          "سأل عن سعر الباقة\n"
          "فريق مبيعات متميز")


def classify(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    return rules.classify_transcripts(df).orderBy("k").collect()


def test_sample_meeting_classification(spark):
    r = classify(spark, [SAMPLE])[0]
    assert r.objection == "money"
    assert r.topic_phrase == rules.TOPIC_GENERIC
    assert r.client_name == rules.CLIENT_DEFAULT
    assert r.followup_3 == rules.MESSAGE_3["money"].replace("{client_name}", rules.CLIENT_DEFAULT)


def test_sample_sectors(spark):
    df = spark.createDataFrame([(SAMPLE,)], "text string")
    got = df.select(rules.detected_sectors("text").alias("s")).first().s
    assert got == ["Business", "Marketing", "Sales"]


def test_objection_order_and_marker(spark):
    rows = classify(spark, ["جودة و سعر", "جودة فقط", "0:04 - يارب سترك", "يارب سترك", "متجر"])
    assert rows[0].objection == "money" and rows[1].objection == "quality"
    assert rows[2].client_name == rules.CLIENT_MARKER_NAME and rows[3].client_name == rules.CLIENT_DEFAULT
    assert rows[4].topic_phrase == rules.TOPIC_STORE


def test_describe_documents(spark):
    catalog = spark.createDataFrame([("S", "ugc تسويق.pdf"), ("S", "cached.pdf"), ("S", "other.pdf")],
                                    "sector string, name string")
    cache = spark.createDataFrame([("cached.pdf", "", 0)], "name string, text string, ordinal long")
    got = {r.name: r.description for r in rules.describe_documents(catalog, cache).collect()}
    assert got["ugc تسويق.pdf"] == rules.DESCRIPTION_RULES[1][1]
    assert got["cached.pdf"] == ""
    assert got["other.pdf"] == rules.DESCRIPTION_DEFAULT


def test_message_one_without_document(spark):
    df = spark.createDataFrame([("x", "العميل", "topic")], "k string, client_name string, topic_phrase string")
    picks = spark.createDataFrame([], "k string, rank int, name string, description string")
    c = df.withColumn("objection", F.lit("none")).withColumn("followup_3", F.lit("")).withColumn("followup_4", F.lit(""))
    r = rules.build_followup_record(c, picks, "k").first()
    assert "**None**" in r.followup_1 and r.selected_pdf_1 is None and r.pdf1_description == ""
    assert r.schedule.followup_1_time == rules.SCHEDULE[0][1]


def test_template_values_are_not_rescanned(spark):
    df = spark.createDataFrame([("x", "{topic}", "T")], "k string, client_name string, topic_phrase string")
    picks = spark.createDataFrame([], "k string, rank int, name string, description string")
    c = df.withColumn("objection", F.lit("none")).withColumn("followup_3", F.lit("")).withColumn("followup_4", F.lit(""))
    r = rules.build_followup_record(c, picks, "k").first()
    assert r.followup_1.startswith("مرحبًا {topic}،")


def test_sector_join_form_equals_literal_form(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "nothing")], "conv_id int, text string")
    lex = spark.createDataFrame(rules.SECTOR_LEXICON, "keyword string, sector string")
    a = sorted(tuple(r) for r in rules.detect_sectors_join(df, lex).collect())
    b = sorted(tuple(r) for r in df.select("conv_id", F.explode(rules.detected_sectors("text")).alias("s")).collect())
    assert a == b


def test_a_large_lexicon_meets_long_texts(spark):
    """100,000 keywords and a text of a million characters, against a plain
    substring search for some of them."""
    import random
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(100_000)} | {"é😀x", "😀"})
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    texts = [(1, long), (2, "no keyword: ZZZ"), (3, "É😀X"), (4, None), (5, ""), (6, "abc")]
    lexicon = spark.createDataFrame([(w, f"s{i % 50}") for i, w in enumerate(words)] + [(None, "none")], "keyword string, sector string")
    got = {(r.conv_id, r.sector) for r in rules.detect_sectors_join(spark.createDataFrame(texts, "conv_id int, text string"), lexicon).collect()}
    want = {(k, f"s{i % 50}") for i, w in enumerate(words) for k, t in texts[1:] if t and w in t.lower()}
    assert {g for g in got if g[0] != 1} == want
    assert {s for k, s in got if k == 1} == {f"s{i}" for i in range(50)}


def test_lexicon_of_short_empty_and_no_keywords(spark):
    t = spark.createDataFrame([(1, "Ab"), (2, ""), (3, None)], "conv_id int, text string")

    def found(rows):
        return sorted(map(tuple, rules.detect_sectors_join(t, spark.createDataFrame(rows, "keyword string, sector string")).collect()))

    assert found([]) == []
    assert found([("", "all")]) == [(1, "all"), (2, "all")]
    assert found([("B", "b"), ("ab", "ab"), ("abc", "x"), ("", "all"), ("b", "b2")]) == [(1, "ab"), (1, "all"), (1, "b"), (1, "b2"), (2, "all")]
