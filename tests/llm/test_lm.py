import collections
import math
import zlib

import numpy as np

from parley.llm.lm_score import lm_score, pack, perplexity, unpack
from parley.llm.pitman_yor import DISCOUNT, draw_tables, predict
from tests.llm.helpers import driver, frame, odd_documents


def base(rows):
    toks = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = collections.Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 4))
            for (i, _), ws, h in zip(rows, toks, held)]


def test_counts_and_base_score(spark):
    rows = odd_documents()
    # Small buckets: several word and pair buckets.
    for options in ({}, {"words_a_bucket": 50, "pairs_a_bucket": 9000}):
        got = lm_score(frame(spark, rows), **options).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == \
            sorted(base(rows), key=str)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = [(d["doc_id"], d["text"]) for d in driver("documents")]
    got = {r.held_out: r for r in perplexity(lm_score(frame(spark, docs))).collect()}
    assert got[True].perplexity < got[True].base_perplexity


def test_only_held_out_rows_and_no_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm_score(frame(spark, [(i, "a b") for i in held])).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert lm_score(frame(spark, [])).count() == 0


def test_predictive_probabilities_sum_to_one(spark):
    """One context, all words: the probabilities of the known words and the
    unknown one add up, seen through one-token texts."""
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:30]
    texts = ["a b c", "a a", "b", "c c a", "d"]
    probes = ["", "a", "b", "c", "d", "zzz"]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:len(probes)]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(train)] + list(zip(held, probes))
    got = {r.doc_id: r.score for r in lm_score(frame(spark, rows), kept=1).collect()}
    # A probe's score is log P(word | end) + log P(end | word); measure P(end | word) apart by doubling texts is not
    # needed here: the empty probe is P(end | end), and the others must leave it less than the rest of the mass.
    assert 0 < 10 ** got[held[0]] < 1
    assert sum(10 ** got[i] for i in held[1:]) < 1 - 10 ** got[held[0]]


def test_predict_is_a_distribution():
    c = np.array([3, 0, 1, 7])
    t = np.array([1, 0, 1, 3])
    parent = np.array([0.4, 0.3, 0.2, 0.1])
    assert abs(predict(c, t, 1.5, c.sum(), t.sum(), parent).sum() - 1) < 1e-12


def stirling(n, d=DISCOUNT):
    s = np.zeros((n + 2, n + 2))
    s[1, 1] = 1
    for i in range(1, n + 1):
        for k in range(1, i + 2):
            s[i + 1, k] = s[i, k - 1] + (i - d * k) * s[i, k]
    return s


def test_tables_follow_their_exact_conditional():
    s = stirling(12)
    rng = np.random.default_rng(0)
    for c in (2, 3, 6, 12):
        for g in (0.05, 0.8, 5.0, 200.0):
            t = np.arange(1, c + 1)
            want = s[c, 1:c + 1] * g ** t
            want /= want.sum()
            got = np.bincount(draw_tables(np.full(20_000, c), np.full(20_000, g), rng), minlength=c + 1)[1:] / 20_000
            assert np.abs(got - want).max() < 0.02, (c, g)
    big = draw_tables(np.array([1, 10 ** 6, 10 ** 6]), np.array([3.0, 1e-9, 400.0]), rng)
    assert big[0] == 1 and big[1] == 1 and 500 < big[2] < 1100


def test_blobs_round_trip():
    for a, up in ((np.arange(10) ** 2, True), (np.array([5, 1, 2 ** 40]), False), (np.zeros(0, np.int64), True),
                  (np.array([1, 2 ** 63 + 5], np.uint64), True)):
        assert (unpack(pack(a, up), a.dtype.str, up) == a).all()
