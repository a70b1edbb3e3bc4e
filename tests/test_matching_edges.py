"""Pruned rankers against brute force on hand-made inputs that defeat the
shortcuts: digits in transcripts (masks do not collapse), the placeholder
character inside a transcript, empty texts, upper case, emoji, one name in
two sectors, duplicate and empty topics."""

from pyspark.sql import functions as F

from parley.operators import matching

TEXTS = [
    (1, "Report 2024: sales doc_12 reached 1200 units; see doc_7.pdf"),
    (2, ""),
    (3, "a\u0000b doc_1 with nul"),
    (4, "no match here at all"),
    (5, "ÄÖ doc 12 😀 emoji doc_😀.pdf"),
    (6, "DOC_3.PDF DOC_30.PDF upper case"),
]
CATALOG = [(s, n) for s in ("Sales", "Marketing") for n in
           ["doc_1.pdf", "doc_12.pdf", "doc_7.pdf", "doc_3.pdf", "doc_30.pdf", "doc_😀.pdf", "x.pdf",
            "Report 2024.pdf", "ÄÖ.pdf"]] + [("Sales", "only_sales_2024.pdf")]
SECTORS = [(i, s) for i, _ in TEXTS for s in ("Sales", "Marketing")] + [(1, "Missing")]


def test_rank_by_name_edges(spark):
    t = spark.createDataFrame(TEXTS, "conv_id int, text string")
    c = spark.createDataFrame(CATALOG, "sector string, name string")
    s = spark.createDataFrame(SECTORS, "conv_id int, sector string")
    for k, group in ((2, 256), (3, 1)):
        a = sorted(tuple(r) for r in matching.rank_by_name(t, s, c, "conv_id", k=k, group=group).collect())
        b = sorted(tuple(r) for r in matching.rank_by_name_bruteforce(t, s, c, "conv_id", k=k).collect())
        assert a == b
        assert len(a) == k * len(TEXTS)


def test_match_documents_edges(spark):
    docs = [(i, f"d{i}.pdf", txt) for i, txt in enumerate(
        ["", "short", "the and", "that with", "x" * 2500, "with that " * 300, "la aiêvi", " \n spaced  out\t",
         "the and the and", "😀 emoji text"])]
    corpus = spark.createDataFrame(docs, "ordinal long, name string, text string")
    topics = spark.createDataFrame(
        [("a", 0, "that with"), ("a", 1, "that with"), ("a", 2, "the and"),
         ("b", 0, ""), ("c", 0, "LA AIÊVI"), ("c", 1, "x"), ("d", 0, "😀")],
        "meeting_id string, pos long, topic string")
    for k, probe in ((2, 8), (3, 1)):
        a = sorted(tuple(r) for r in matching.match_documents(topics, corpus, k=k, probe=probe, lists=probe).collect())
        b = sorted(tuple(r) for r in matching.match_documents_bruteforce(topics, corpus, k=k).collect())
        assert a == b and len(a) == 4 * k


def _words(seed, n, size):
    import random
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n)]


def _scored(spark, run):
    counter = spark.sparkContext.accumulator(0)
    rows = run(counter).collect()
    return rows, counter.value


def test_repeated_topics_and_one_hot_length_make_few_ratios(spark):
    """All heads have one length, so the length alone prunes nothing: ten times
    the meetings over the same topics cost the same, and the ratios computed
    stay below topics + documents, of a hundred times as many pairs."""
    texts = _words(1, 3000, 20)
    corpus = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "ordinal long, name string, text string")
    wanted = [texts[i * 7] for i in range(100)]

    def run(copies):
        topics = spark.createDataFrame([(m * 100 + i, 0, t) for m in range(copies) for i, t in enumerate(wanted)],
                                       "meeting_id long, pos long, topic string")
        return _scored(spark, lambda n: matching.match_documents(topics, corpus, k=1, scored=n))

    (one, few), (ten, again) = run(1), run(10)
    assert len(one) == 100 and len(ten) == 1000 and few == again
    assert few <= len(texts) + len(wanted)
    assert {(r.name, r.score) for r in one} == {(f"d{i * 7}", 100.0) for i in range(100)}


def test_names_stream_until_no_bound_reaches_the_best(spark):
    """Every transcript holds its best name; the matcher sees a few names of
    each, whatever the size of the catalog, and copies of the list serve a hot
    signature."""
    names = [f"{w}.pdf" for w in _words(2, 2000, 12)]
    catalog = spark.createDataFrame([("Sales", n) for n in names], "sector string, name string")
    texts = [(i, names[i * 11]) for i in range(150)]
    t = spark.createDataFrame(texts, "conv_id long, text string")
    sectors = spark.createDataFrame([(i, "Sales") for i, _ in texts], "conv_id long, sector string")
    for group in (256, 10):
        rows, n = _scored(spark, lambda c: matching.rank_by_name(t, sectors, catalog, k=1, group=group, scored=c))
        assert {(r.conv_id, r.name, r.score) for r in rows} == {(i, x, 100) for i, x in texts}
        assert n <= len(texts) + len(names)


def test_block_borders_and_ties_do_not_change_the_match(spark):
    texts = _words(3, 60, 5) + ["aa", "ab", "", "aa"]
    corpus = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "ordinal long, name string, text string").repartition(4)
    topics = spark.createDataFrame([(m, p, t) for m in range(12) for p, t in enumerate(_words(m, 1 + m % 3, 2 + m % 4))],
                                   "meeting_id long, pos long, topic string")
    want = sorted(map(tuple, matching.match_documents_bruteforce(topics, corpus, k=3).collect()))
    for lists, probe in ((1, 3), (5, 1), (4096, 4)):
        assert sorted(map(tuple, matching.match_documents(topics, corpus, k=3, probe=probe, lists=lists).collect())) == want
