import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from parley.llm import hard_negatives as hn

ROWS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType()),
                   StructField("uid", StringType()), StructField("score", IntegerType())])


def f32(x):
    return float(np.float32(x))


def brute_force(rows, every, n_pos, n_neg, low):
    """Triples by plain sorting; rows are (id, vector, label)."""
    use = [(n, i, [math.floor(256 * x) for x in v], lab) for n, (i, v, lab) in enumerate(rows)
           if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v, lab in use:
        if i is None or i % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, c) for m, j, w, c in use if m != n)
        for p, null, pid, _, _ in [r for r in ranked if r[4] == lab][:n_pos]:
            near = [r for r in ranked if r[4] != lab and low * -p <= 100 * -r[0] <= 100 * -p][:n_neg]
            out += [(i, None if null else pid, k, None if r[1] else r[2], -p, -r[0]) for k, r in enumerate(near, 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "u", 1) for i, v, lab in rows], ROWS)


def odd_rows(n=120, seed=1):
    rng = random.Random(seed)
    few = [[f32(rng.gauss(0.5, 1)) for _ in range(4)] for _ in range(12)]
    rows = [(i, [f32(x + rng.choice([0, 0, 0.01])) for x in rng.choice(few)], rng.randrange(3)) for i in range(n)]
    inf, nan = float("inf"), float("nan")
    rows += [(0, rows[0][1], 1), (10, None, 1), (20, few[0], None), (30, [1.0, nan, 0.0, 0.0], 1), (40, [inf, 0.0, 0.0, 0.0], 1),
             (50, [None, 1.0, 1.0, 1.0], 2), (None, few[1], 2), (None, few[1], 0), (60, [], 1), (70, few[2][:2], 0), (80, few[2] + [9.0], 1),
             (-10, few[3], 1), (90, [0.0] * 4, 2)]
    return rows + rows[5:9]


@pytest.mark.parametrize("block,held,n_rows", [(hn.BLOCK, hn.HELD, hn.ROWS), (3, 10, 7)])
@pytest.mark.parametrize("n_pos,n_neg,low", [(5, 5, 80), (2, 1, 0), (3, 4, 100)])
def test_triples_equal_brute_force(spark, monkeypatch, block, held, n_rows, n_pos, n_neg, low):
    monkeypatch.setattr(hn, "HELD", held)
    monkeypatch.setattr(hn, "ROWS", n_rows)
    rows = odd_rows()
    got = hn.hard_negatives(frame(spark, rows).repartition(4), every=10, n_positives=n_pos, n_negatives=n_neg, low=low, block=block)
    assert got.schema == hn.RESULT
    want = brute_force(rows, 10, n_pos, n_neg, low)
    assert want and sorted(map(tuple, got.collect()), key=repr) == want


def test_empty_table_and_a_third_of_equal_rows(spark):
    assert hn.hard_negatives(frame(spark, [])).collect() == []
    assert hn.hard_negatives(frame(spark, [(1, [1.0], 1)])).collect() == []
    rows = [(i, [1.0, 2.0], i % 2) for i in range(300)] + [(1000 + i, [f32(math.sin(i)), f32(math.cos(i))], i % 4) for i in range(100)]
    got = hn.hard_negatives(frame(spark, rows).repartition(6), every=50)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows, 50, 5, 5, 80)


def test_packed_keys_sort_by_anchor_score_kind_and_id():
    rng = random.Random(2)
    keys = [(rng.randrange(3), rng.choice([-(1 << 63), -5, 0, 7, (1 << 63) - 1]), rng.randrange(2), rng.choice([None, -(1 << 63), -1, 0, 8]), rng.randrange(9))
            for _ in range(500)]
    assert all(hn.unpacked(hn.packed(*k)) == k for k in keys)
    want = sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3] is None, k[3] or 0, k[4]))
    assert sorted(keys, key=lambda k: hn.packed(*k)) == want


def test_the_walk_is_a_stream():
    """It asks for one pair at a time and never reads ahead."""
    seen = []

    def pairs():
        for p in [(9, 0, 1, 1), (9, 1, 2, 2), (8, 0, 3, 3), (7, 1, 4, 4), (1, 1, 5, 5)]:
            seen.append(p)
            yield hn.packed(0, p[0], p[1], p[2], p[3]), 77

    it = hn.walk(pairs(), 2, 80)
    assert tuple(next(it)) == (77, 1, 1, 2, 9, 9) and len(seen) == 2
    assert [tuple(r) for r in it] == [(77, 3, 1, 4, 8, 7)]  # 7 < 80 percent of 9


def test_products_are_exact_at_every_size():
    for top in (1000, 1 << 27, 1 << 30):
        rng = np.random.default_rng(top)
        a, b = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (7, 8))
        want = [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
        if max(abs(x) for r in want for x in r) < 1 << 63:
            assert hn.products(a, b).tolist() == want
    with pytest.raises(OverflowError):
        hn.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_vectors_are_filled_to_the_width():
    got = hn.matrix(pa.array([[1, 2, 3], [], [4]], pa.list_(pa.int64())), 2)
    assert got.tolist() == [[1, 2], [0, 0], [4, 0]]
