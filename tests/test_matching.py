import heapq
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from parley import fixtures as fx
from parley.functions.similarity import name_ratio, sequence_ratio
from parley.operators import inference, matching, rules

SF = "/root/testdata/sf0.001"


def test_ratio_is_difflib_and_asymmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", "x" * 340)], "a string, b string")
    got = [r.r for r in df.select(sequence_ratio("a", "b").alias("r")).collect()]
    assert got[:2] == [0.25, 0.5]
    assert got[2] == 1.0
    assert got[3] == SequenceMatcher(None, "abc", "x" * 340).ratio()


def test_name_ratio_rounding_and_empty(spark):
    df = spark.createDataFrame([("hello world", "hello.pdf"), ("", "x"), ("a", "")], "a string, b string")
    got = [r.s for r in df.select(name_ratio("a", "b").alias("s")).collect()]
    assert got[0] == int(round(100 * SequenceMatcher(None, "hello world", "hello.pdf").ratio()))
    assert got[1:] == [0, 0]


def _topics_and_corpus(spark):
    t = fx.transcripts(spark, SF)
    return t, inference.keyword_topics(t, "conv_id"), fx.corpus(spark, SF)


def test_pruned_match_equals_bruteforce(spark):
    _, topics, corpus = _topics_and_corpus(spark)
    a = sorted(tuple(r) for r in matching.match_documents(topics, corpus, key="conv_id").collect())
    b = sorted(tuple(r) for r in matching.match_documents_bruteforce(topics, corpus, key="conv_id").collect())
    assert a == b and len(a) > 0


def test_match_equals_a_full_score_table(spark):
    """A few meetings against every document: a table of exact mean ratios,
    the two smallest by (-mean, ordinal)."""
    _, topics, corpus = _topics_and_corpus(spark)
    heads = {r.ordinal: " ".join(r.text[:2000].split()).lower() for r in corpus.select("ordinal", "text").collect()}
    names = {r.ordinal: r.name for r in corpus.select("ordinal", "name").collect()}
    wanted = topics.filter("conv_id < 3").orderBy("conv_id", "pos").collect()
    got = {(r.conv_id, r.rank): r.name for r in matching.match_documents(topics, corpus, key="conv_id").collect()}
    for conv in {r.conv_id for r in wanted}:
        mine = [r.topic.lower() for r in wanted if r.conv_id == conv]
        table = [[100 * SequenceMatcher(None, t, h).ratio() for t in mine] for h in heads.values()]
        means = [(-sum(row) / len(mine), ordinal) for row, ordinal in zip(table, heads)]
        first, second = heapq.nsmallest(2, means)
        assert (got[conv, 1], got[conv, 2]) == (names[first[1]], names[second[1]])


def test_match_takes_a_corpus_without_numbers(spark):
    """A built corpus has no ordinal: (sector, name) names its documents."""
    _, topics, corpus = _topics_and_corpus(spark)
    built = corpus.filter("ordinal < 40").drop("ordinal")
    few = topics.filter("conv_id < 2")
    got = matching.matched_summaries(matching.match_documents(few, built, key="conv_id"), built).collect()
    brute = matching.match_documents_bruteforce(few, built, key="conv_id").collect()
    assert sorted((r.conv_id, r.rank, r.name, r.score) for r in got) == sorted((r.conv_id, r.rank, r.name, r.score) for r in brute)
    assert len(got) == 4 and all(r.summary.endswith("...") for r in got)


def test_pruned_name_rank_equals_bruteforce(spark):
    t, _, corpus = _topics_and_corpus(spark)
    sectors = t.select("conv_id", F.explode(rules.detected_sectors("text", fx.fixture_words())).alias("sector"))
    a = sorted(tuple(r) for r in matching.rank_by_name(t, sectors, corpus, key="conv_id").collect())
    b = sorted(tuple(r) for r in matching.rank_by_name_bruteforce(t, sectors, corpus, key="conv_id").collect())
    assert a == b and len(a) > 0


def test_document_block_order(spark):
    s = spark.createDataFrame([("m", 2, "b.pdf", "two"), ("m", 1, "a.pdf", "one")],
                              "meeting_id string, rank int, name string, summary string")
    assert matching.document_block(s).first().document_block == "a.pdf: one\nb.pdf: two"
