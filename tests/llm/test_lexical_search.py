import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from parley.llm import lexical_search as ls
from parley.llm import tokens as tk
from parley.llm.query_sharing import classes, mine
from tests.llm.helpers import frame, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("rank", StringType()),
                    StructField("score", StringType())])


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_force(docs, items, k=50):
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, wanted in terms.items():
        scored = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in wanted if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def odd_items():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "été", "ñandú", "x1", "of", "the", "two", "zzz", "ß"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(30)]
    return rows + [(40, None), (41, ""), (42, " ,;"), (43, "OF the, of"), (43, "Alpha"), (None, "beta"), (None, "x1"), (3, rows[3][1]),
                   (44, "never-seen"), (45, "x" * 50_000)]


@pytest.mark.parametrize("block,k", [(ls.BLOCK, 50), (7, 3)])
def test_ranks_equal_brute_force(spark, monkeypatch, block, k):
    docs, items = odd_documents(), odd_items()
    monkeypatch.setattr(ls, "CHUNK", 4000)
    monkeypatch.setattr(ls, "CELLS", 3000)
    monkeypatch.setattr(ls, "HELD", 50)
    got = ls.lexical_search(frame(spark, docs).repartition(5), spark.createDataFrame([(*i, "a", "b") for i in items], ITEMS), k=k, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs, items, k)


def test_empty_tables_and_text_ids(spark):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "of the", "a", "b")], ITEMS)
    docs = spark.createDataFrame([("b", "of x"), ("a", "of x"), (None, "of x"), ("c", "y")], "doc_id string, text string")
    assert ls.lexical_search(frame(spark, []), some).collect() == []
    assert ls.lexical_search(docs, none).collect() == []
    assert ls.lexical_search(docs.where("doc_id = 'z'"), none).collect() == []
    got = ls.lexical_search(docs, some)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["a", "b", None]


def test_the_plan_adds_every_term_once():
    rng = np.random.default_rng(0)
    for n_items, n_terms in ((1, 1), (1, 9), (12, 30), (60, 25)):
        hold = rng.random((n_items, n_terms)) < 0.4
        hold[np.arange(n_items), rng.integers(0, n_terms, n_items)] = True
        item, term = np.nonzero(hold)
        plan = mine(item, np.array([f"t{t:03d}" for t in term], object), n_items)
        value = rng.integers(0, 1000, (n_terms, 5))
        leaves = np.zeros((plan.n_leaves, 5), np.int64)
        np.add.at(leaves, plan.leaf, value[[int(t[1:]) for t in plan.terms]])
        assert (plan.evaluate(leaves) == hold @ value).all()
        assert len(plan.nodes) + len(plan.left) <= hold.sum()


def test_shared_sets_are_added_up_once():
    # Ten items with the same six terms and one of their own: the six are one leaf.
    pairs = [(i, t) for i in range(10) for t in "abcdef"] + [(i, f"own{i}") for i in range(10)]
    item, term = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], object)
    listed, leaf, of_class = classes(item, term)
    assert of_class[0] == tuple(range(10)) and listed[:6] == list("abcdef") and (leaf[:6] == 0).all()
    # Two shared sets that occur together become an inner node.
    pairs = [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (3, "b")]
    plan = mine(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], object), 4)
    assert len(plan.left) == 1 and len(plan.nodes) == 4


def test_words_of_equal_hash_are_different_terms():
    word = "a"
    while len(word) < 1024:  # Thue-Morse: the polynomial hash of the complement is the same
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{other} {word} {word[:-1]} abcdefgh abcdefghi x".encode()
    data = np.frombuffer(text, np.uint8)
    s, e, _ = tk.spans(data, np.array([0, len(data)]), tk.ALNUM)
    assert ls.TermTable([word, "abcdefgh", other]).find(data, s, e).tolist() == [2, 0, -1, 1, -1, -1]
    assert ls.TermTable([word]).find(data, s, e).tolist() == [-1, 0, -1, -1, -1, -1]
    assert ls.TermTable([]).find(data, s, e).tolist() == [-1] * 6


def test_long_rows_are_cut_between_words():
    texts = ["", "a bc " * 50, "x" * 300 + " y", "q", "w" * 40]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    at, row = ls.cut_rows(data, offsets, 20)
    assert at[0] == 0 and at[-1] == len(data) and (np.diff(at) >= 0).all() and set(row.tolist()) == set(range(5))
    words = [(int(row[i]), w) for i in range(len(row)) for w in data[at[i]:at[i + 1]].tobytes().split()]
    assert words == [(i, w) for i, r in enumerate(raw) for w in r.split()]


def test_ties_keep_the_smallest_ids():
    best = ls._Best(1, 2, pa.int64())
    for ids in ([9, 8], [7, None], [3, 5]):
        best.offer(np.array([[4, 4]]), pa.array(ids))
    assert best.cut().column("doc_id").to_pylist() == [3, 5]
