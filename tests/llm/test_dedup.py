import hashlib
import re

from pyspark.sql import functions as F

from parley.llm import exact_dedup as module
from parley.llm.exact_dedup import exact_dedup
from parley.llm.simhash import BKTree, fingerprint, simhash_near_dedup
from tests.llm.helpers import frame, odd_documents


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for n in norm:
        members = [i for i, m in enumerate(norm) if m == n]
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out.append((rows[best][0], len(members), hashlib.sha256(n.encode()).hexdigest()))
    return out


def check(spark, rows, **options):
    got = exact_dedup(frame(spark, rows), **options).collect()
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(rows))), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [(r.text_sha256) for r in got if r.kept]
    assert sorted(kept) == sorted(set(w[2] for w in brute(rows)))  # one row of each group
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_odd_rows(spark):
    check(spark, odd_documents())


def test_exact_dedup_survives_hash_collisions(spark):
    # Only four hash values: groups hold different texts that bytes must tell apart.
    check(spark, odd_documents()[:40], hash_fn=lambda c: F.pmod(F.length(c), F.lit(4)).cast("string").cast("binary"))


def test_exact_dedup_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_takes_text_ids_and_the_smallest_long(spark):
    rows = [("b", "x y"), ("a", "xy"), ("a2", "x y"), (None, "x y"), ("c", "z")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {
        "a": ("a2", 4, False), "a2": ("a2", 4, True), "b": ("a2", 4, False), None: ("a2", 4, False), "c": ("c", 1, True)}
    least = -(1 << 63)
    got = exact_dedup(spark.createDataFrame([(5, "q"), (least, "q"), (None, "q")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(5, least, False), (least, least, True), (None, least, False)}


def test_exact_dedup_deals_out_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(module, "PART", 3)
    rows = [(i, "same  text" if i % 3 else f"own {i}") for i in range(90)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 90 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(1, 60)}
    assert [r.doc_id for r in got if r.kept and r.doc_id % 3] == [1]


def votes(text):
    import xxhash
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows, prints):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None)
            for i in range(len(rows))]


def test_simhash_components_equal_brute_force(spark):
    rows = [(i, t) for i, t in odd_documents() if not t or len(t) < 5000]
    rows += [(300 + k, " ".join(["w%d" % (j + (j == 40) * k) for j in range(200)])) for k in range(12)]
    prints = [votes(t) for _, t in rows]
    assert prints == [fingerprint((t or "").encode()) for _, t in rows]
    want = sorted(((i, "%016x" % p, c) for (i, _), p, c in zip(rows, prints, components(rows, prints))), key=str)
    for size in (20_000, 2):  # small trees: shards are dealt into several cells
        got = simhash_near_dedup(frame(spark, rows), tree_size=size).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_simhash_empty(spark):
    assert simhash_near_dedup(frame(spark, [])).count() == 0


def test_bk_tree_finds_all_within_radius():
    import random
    rng = random.Random(1)
    keys = [rng.getrandbits(16) for _ in range(400)]
    tree = BKTree()
    for k in keys:
        tree.add(k)
    for q in keys[:50]:
        assert sorted(tree.within(q, 3)) == sorted({k for k in keys if (k ^ q).bit_count() <= 3})


def test_dense_group_writes_few_links(spark):
    from parley.llm.simhash import links
    values = [(1 << a) | (1 << b) for a in range(20) for b in range(a)]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    assert links(fps, 2).count() < 3 * len(values)
