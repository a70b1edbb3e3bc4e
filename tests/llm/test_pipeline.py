

import corpus_pipeline as cp
from parley.llm import graph
from parley.llm.common import written
from tests.llm.helpers import SF, driver, frame, odd_documents
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_dedup import brute as copies, components, votes


def ids(df):
    return sorted((r.doc_id if r.doc_id is not None else -1) for r in df.select("doc_id").collect())


def test_filtering_stages_equal_brute_force(spark):
    items = [(b["item_id"], b["text"]) for b in driver("benchmark")]
    rows = [(i, t) for i, t in odd_documents() if not t or len(t) < 5000] + [(700, "intro " + items[0][1]), (701, items[3][1].upper())]
    rows += [(800 + k, " ".join("w%d" % (j + (j == 40) * k) for j in range(200))) for k in range(6)]
    docs = written(frame(spark, rows), "t")
    left = cp.exact_stage(spark, docs, SF)
    assert left.columns == docs.columns
    best = {}
    for (i, t), (keep, _, sha) in zip(rows, copies(rows)):
        best[sha] = keep
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(i if i is not None else -1 for i, _ in kept) == sorted(k if k is not None else -1 for k in best.values())
    near = cp.near_stage(spark, written(left, "t"), SF)
    prints = [votes(t) for _, t in kept]
    groups = components(kept, prints)
    assert ids(near) == sorted(set(g if g is not None else -1 for g in groups)) and near.columns == docs.columns
    third = [(r.doc_id, r.text) for r in near.collect()]
    clean = cp.benchmark_stage(spark, written(near, "t"), SF)
    assert ids(clean) == sorted((r[0] if r[0] is not None else -1) for r in leaks(third, items) if not r[-1])
    assert 700 not in ids(clean) and 701 not in ids(clean)


def test_every_stage_runs_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    pieces = cp.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_stages_take_empty_tables(spark):
    docs = frame(spark, [])
    for _, stage in cp.STAGES:
        assert written(stage(spark, docs, SF), "t").count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_registered_queries():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
