import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from parley.llm.decontaminate import cut_spans, decontamination, find_benchmark, phrase_blocks, word_hashes
from parley.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from tests.llm.helpers import driver, frame, odd_documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for name, text in items:
            p = split(text)
            n = min(10, len(p))
            wins = {tuple(p[a:a + n]) for a in range(len(p) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a:a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    passage = words(rng, 40)
    docs = odd_documents()[:30] + [(500, "start " + passage), (501, passage.upper()), (502, (passage + " zz ") * 50),
                                   (503, " ".join(passage.split()[:9])), (504, passage[:100] + " tiny item " + passage[100:])]
    items = [(1, passage), (2, "tiny item"), (3, None), (4, "..."), (12, " ".join(passage.split()[5:30])), (None, "only here"), (1, passage)]
    return docs, items


def as_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_equals_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    for options in ({}, {"shard": 64}, {"block": 60}, {"shard": 100, "block": 100}):
        got = decontamination(frame(spark, docs), as_items(spark, items), **options).drop("spans").collect()
        assert sorted((tuple(r) for r in got), key=str) == want, options


def test_long_items_are_dealt_over_blocks():
    rng = random.Random(8)
    items = [("a", "one two"), ("b", words(rng, 500)), ("c", words(rng, 30)), ("d", words(rng, 100))]
    want = []
    for name, text in items:
        h = word_hashes(text).tolist()
        want += [(name, tuple(h[i:i + 10])) for i in range(max(1, len(h) - 9))]
    blocks = list(phrase_blocks(iter(items), 10, 200))
    assert all(phrases.size <= 200 for phrases, *_ in blocks)
    assert [(names[w], tuple(p[10 - u:].tolist())) for phrases, used, who, names in blocks
            for p, u, w in zip(phrases, used, who)] == want


def test_driver_tables(spark):
    docs = [(d["doc_id"], d["text"]) for d in driver("documents")]
    items = [(b["item_id"], b["text"]) for b in driver("benchmark")]
    got = decontamination(frame(spark, docs), as_items(spark, items)).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    assert decontamination(frame(spark, []), as_items(spark, [])).count() == 0
    rows = decontamination(frame(spark, [(1, "some text")]), as_items(spark, [])).collect()
    assert [(r.n_words, r.contaminated) for r in rows] == [(2, False)]


def test_cut_spans_removes_the_phrase(spark):
    docs = frame(spark, [(1, "Keep thís, tiny   ITEM and keep"), (2, "clean é"), (3, "tiny item")])
    found = find_benchmark(docs, as_items(spark, [(2, "tiny item")]))
    got = docs.select("doc_id", "text").join(found, "doc_id").select("doc_id", cut_spans(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {1: "Keep thís, and keep", 2: "clean é", 3: ""}


def test_fm_index_on_random_words():
    rng = np.random.default_rng(2)
    for sigma in (1, 3, 50):
        s = rng.integers(1, sigma + 1, 700).astype(np.uint32)
        s[[99, 100, 350, 699]] = 0
        sa = suffix_array(s)

        def key(i):
            # A separator ends the comparison and is ordered by place.
            stop = i + np.flatnonzero(s[i:] == 0)[0]
            return [(1, x) for x in s[i:stop]] + [(0, stop)]
        assert sa.tolist() == sorted(range(len(s)), key=key)
        w = WaveletMatrix(s, sigma)
        at = rng.integers(0, 701, 50)
        c = rng.integers(0, sigma + 1, 50)
        assert w.rank(c, at).tolist() == [int((s[:a] == x).sum()) for a, x in zip(at, c)]
        assert w.access(np.arange(700)).tolist() == s.tolist()
        index = FMIndex(s, sigma, sample=8)
        pat = np.array([s[a:a + 3] for a in (5, 200, 400)], np.int64)
        lo, hi = index.search(pat)
        for p, x, y in zip(pat, lo, hi):
            want = [a for a in range(698) if (s[a:a + 3] == p).all()]
            assert sorted(index.locate(np.arange(x, y)).tolist()) == want
