"""Operator 7, SimHash near-dedup with BK-trees.

Fingerprints: 64 bits, one vote per word shingle (repeats included). Copies
share a fingerprint, so only distinct fingerprints are searched. They are
sharded by the pigeonhole rule: two fingerprints within ``max_bits`` bits agree
on at least one of ``max_bits + 1`` bit blocks, so a shard is a block and its
value, and no link lies outside a shard. Each shard's BK-tree (children keyed
by their integer Hamming distance to the parent) is built where its queries
are, and a query follows only the edges within the radius.

A tree cannot be broadcast to everybody at scale: its size grows with the
data. Instead the shuffle brings each shard's nodes and queries together. A
shard with more than ``tree_size`` fingerprints is dealt into several trees
and several query parts, and each tree meets each part in a task of its own,
so no task depends on the size of the largest shard. A cell reports only the
links that join two of its local groups (a spanning forest), at most one for
each fingerprint: components stay whole, and a dense group does not write the
square of its size. Components come from ``graph.components``.

Defined results: null text is empty; a text without words has fingerprint
zero and links like any other; a null id gets its row and the component of
its fingerprint; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parley.llm.common import prepare, texts, written
from parley.llm.graph import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
TREE_SIZE = 20_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the
    shingle hashes."""
    import xxhash
    words = text.lower().split()  # bytes: lowers A-Z and splits on ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo:lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """(doc_id, fp, and row with ``row_col``): fp is the fingerprint as a
    signed 64-bit integer."""
    rows = texts(docs, id_col, text_col, row_col).withColumn("text", F.col("text").cast("binary"))
    kept = [f for f in rows.schema if f.name != "text"]
    rows = rows.select("text", *(f.name for f in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], names=[*b.schema.names[1:], "fp"])

    return rows.mapInArrow(run, StructType([*kept, StructField("fp", LongType())]))


class BKTree:
    """Keys in a tree whose edges carry the Hamming distance to the parent."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, key: int) -> None:
        if self.keys:
            at = 0
            while True:
                d = (self.keys[at] ^ key).bit_count()
                if d == 0:
                    return
                nxt = self.edges[at].get(d)
                if nxt is None:
                    self.edges[at][d] = len(self.keys)
                    break
                at = nxt
        self.keys.append(key)
        self.edges.append({})

    def within(self, key: int, radius: int) -> Iterator[int]:
        stack = [0] if self.keys else []
        while stack:
            at = stack.pop()
            d = (self.keys[at] ^ key).bit_count()
            if d <= radius:
                yield self.keys[at]
            edges = self.edges[at]
            for e in range(max(1, d - radius), d + radius + 1):
                if e in edges:
                    stack.append(edges[e])


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.setdefault(root, root) != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def _search(radius: int):
    """Rows sorted by cell, nodes (role 0) before queries (role 1): builds a
    cell's tree, asks it, and yields links between local groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree, parent = None, BKTree(), {}
        for b in batches:
            out_u, out_v = [], []
            cols = [b.column(i).to_pylist() for i in range(6)]
            for block, value, s, q, role, fp in zip(*cols):
                if cell != (block, value, s, q):
                    cell, tree, parent = (block, value, s, q), BKTree(), {}
                key = fp & 0xFFFFFFFFFFFFFFFF
                if role == 0:
                    tree.add(key)
                    continue
                for other in tree.within(key, radius):
                    if other != key:
                        a, c = _find(parent, key), _find(parent, other)
                        if a != c:
                            parent[a] = c
                            out_u.append(fp)
                            out_v.append(other - (1 << 64) if other >> 63 else other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp, no repeats), enough of
    them to connect every pair within ``max_bits`` bits."""
    n = max_bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = F.array(*[
        F.struct(F.lit(i).alias("block"),
                 F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("value"))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    dealt = fps.select("fp", F.explode(blocks).alias("b")).select("b.block", "b.value", "fp")
    shards = dealt.groupBy("block", "value").agg(F.count("*").alias("m")).where("m > 1").select(
        "block", "value", F.ceil(F.col("m") / tree_size).cast("int").alias("k"))
    inside = dealt.join(shards, ["block", "value"])
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    nodes = inside.select("block", "value", mine.alias("s"), every.alias("q"), F.lit(0).alias("role"), "fp")
    asks = inside.select("block", "value", every.alias("s"), mine.alias("q"), F.lit(1).alias("role"), "fp")
    cell = ["block", "value", "s", "q"]
    return (nodes.unionByName(asks.select(*nodes.columns)).repartition(*cell)
            .sortWithinPartitions(*cell, "role", "fp").mapInArrow(_search(max_bits), "u long, v long"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED,
                       tree_size: int = TREE_SIZE, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links, its own included); with ``row_col``
    also that column as row and root, which names the component even where it
    has no id."""
    prepare(docs.sparkSession)
    marked = written(fingerprints(docs, id_col, text_col, shingle, seed, row_col), "simhash-fps")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits, tree_size))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select(
        *(["row", "root"] if row_col else []), "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
