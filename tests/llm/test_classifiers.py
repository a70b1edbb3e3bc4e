import random

import numpy as np

from parley.llm import quality_crf, toxicity
from tests.llm.helpers import frame, odd_documents, words


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality long, toxic long")


def corpus():
    rng = random.Random(11)
    docs, marks = [], []
    for i in range(400):
        lines = [words(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 6))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            lines = [ln.upper() + "!!" if i % 2 else " | ".join(ln.split()) + " ### $$$" for ln in lines]
        if toxic:
            lines[0] += " you blockhead " + words(rng, 2)
        docs.append((i, "\n".join(lines)))
        marks.append((i, 0 if bad else 1, 1 if toxic else 0))
    return docs, marks


def test_toxicity_held_out(spark):
    docs, marks = corpus()
    odd = [(1000 + (i or 0), t) for i, t in odd_documents()] + [(None, "x")]
    got = toxicity.toxicity(frame(spark, docs + odd), labelled(spark, marks + [(3, None, None), (None, 1, 1), (7, 0, 0)])).collect()
    assert len(got) == len(docs) + len(odd)
    by = {m[0]: m[2] for m in marks}
    held = [r for r in got if r.held_out and r.doc_id in by]
    assert len(held) > 50 and np.mean([r.predicted == by[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id >= 1000)


def test_toxicity_with_few_labels(spark):
    docs, marks = (x[:100] for x in corpus())  # no n-gram lies five standard errors from zero
    got = toxicity.toxicity(frame(spark, docs), labelled(spark, marks)).collect()
    held = [r for r in got if r.held_out and r.doc_id % 4 == 0]
    assert len(held) > 4 and np.mean([r.predicted for r in held]) > 0.7
    assert not any(r.predicted for r in got if r.held_out and r.doc_id % 4)


def test_toxicity_without_labels_or_rows(spark):
    got = toxicity.toxicity(frame(spark, [(1, "a"), (2, None)]), labelled(spark, [])).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in got) and len(got) == 2
    assert toxicity.toxicity(frame(spark, []), labelled(spark, [(1, 1, 1)])).count() == 0


def test_grams_are_counted_once_per_row():
    codes, offsets = toxicity._codes(["abcdabcd", "abcd", ""])
    row, bucket = toxicity.held_grams(codes, offsets, None)
    first = set(bucket[row == 0].tolist())
    assert len(first) == (row == 0).sum() and set(bucket[row == 1].tolist()) < first and (row < 2).all()


def test_quality_held_out(spark):
    docs, marks = corpus()
    odd = [(1000 + (i or 0), t) for i, t in odd_documents()] + [(None, "Fine line.")]
    got = quality_crf.quality(frame(spark, docs + odd), labelled(spark, marks)).collect()
    assert len(got) == len(docs) + len(odd)
    by = {m[0]: m[1] for m in marks}
    held = [r for r in got if r.held_out and r.doc_id in by]
    assert len(held) > 50 and np.mean([r.predicted == by[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.n_lines == 0}
    assert len(empty) == 1


def test_quality_without_labels_or_rows(spark):
    got = quality_crf.quality(frame(spark, [(1, "a"), (2, None)]), labelled(spark, [])).collect()
    assert [r.score for r in got] == [1.0, 1.0]
    assert quality_crf.quality(frame(spark, []), labelled(spark, [(1, 1, 1)])).count() == 0


def test_marginals_equal_enumeration():
    import itertools
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 5, 2])
    good, step = rng.normal(size=11), rng.normal(size=(2, 2))
    chains = quality_crf.Chains(sizes)
    p, psi, alpha, beta, move = chains.marginals(good, step)
    pairs = chains.pairs(psi, alpha, beta, move, np.ones(11))
    want, joint, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(step[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            one += w * np.array(y)
            for i in range(1, n):
                two[y[i - 1], y[i]] += w
        want += (one / total).tolist()
        joint += two / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, joint)


def test_neighbouring_lines_are_features():
    text = b"one line\n\nSECOND LINE!!\nthird"
    x, size, row = quality_crf.line_features(np.frombuffer(text + b"other", np.uint8), np.array([0, len(text), len(text) + 5]))
    k = quality_crf.OWN
    assert size.tolist() == [8, 13, 5, 5] and row.tolist() == [0, 0, 0, 1]
    assert (x[1, k:2 * k] == x[0, :k]).all() and (x[0, 2 * k:] == x[1, :k]).all()
    assert not x[3, k:].any() and not x[0, k:2 * k].any()
