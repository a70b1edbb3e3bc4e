"""Operator 11, ranked lexical search of many queries by common subexpressions.

The items' (item, term) pairs are cut into blocks of about ``BLOCK`` pairs. For
each block a task mines the term sets that items share and lays them out as a
DAG of sums (``query_sharing``). One pass over the documents writes postings:
the document's length and, for the block's terms only, how often each occurs.
Term and corpus statistics are aggregates over them. A second pass turns the
postings of a few documents at a time into the accumulators of the DAG, each
added up once, combines them into the scores of all items and keeps the ``k``
best of each item in this task. Two windows merge the tasks' best rows.

What is sent to the tasks is a block's terms and DAG. All scores are 64-bit
integers, so the order of addition does not matter. Words are looked up by a
64-bit hash and their bytes compared.

Defined results: a null or empty text has no term and never ranks; an item
without terms has no row; rows repeated with their item id (null counts as one
id) are one item holding the terms of all of them; documents repeated with
their id rank one behind the other; among equal scores a null id comes last;
an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from parley.llm import tokens as tk
from parley.llm.common import prepare, row_chunks, string_buffers, texts, written
from parley.llm.query_sharing import SharingPlan, mine

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text whose A-Z are lower-case
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK = 1 << 16
CHUNK = 4 << 20
CELLS = 1 << 21  # numbers of one accumulator table
HELD = 1 << 18  # candidates kept in a task before they are cut to the best

POSTINGS = "n long, terms array<int>, counts array<int>"


class TermTable:
    """Finds the number of a word among the given terms, byte for byte."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.lanes = _lanes(data)
        h = tk.hashes(data, self.at, self.at + self.size)
        order = np.argsort(h, kind="stable")
        h = h[order]
        # Terms that share a hash lie in separate layers.
        first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        depth = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0)) if len(h) else h.astype(int)
        self.layers = [(h[depth == d], order[depth == d]) for d in range(int(depth.max()) + 1)] if len(h) else []

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Term number of each word of a buffer, -1 for others."""
        out = np.full(len(starts), -1, np.int64)
        h, lanes, size = tk.hashes(data, starts, ends), _lanes(data), ends - starts
        for known, number in self.layers:
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            word = np.flatnonzero((known[place] == h) & (out < 0))
            term = number[place[word]]
            equal = self.size[term] == size[word]
            word, term = word[equal], term[equal]
            same, left, lane = np.ones(len(word), bool), np.arange(len(word)), 0
            while len(left):
                w, t = word[left], term[left]
                mask = _MASK[np.minimum(size[w] - lane, 8)]
                same[left] &= ((lanes[starts[w] + lane] ^ self.lanes[self.at[t] + lane]) & mask) == 0
                lane += 8
                left = left[size[w] > lane]
            out[word[same]] = term[same]
        return out


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def cut_rows(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long rows cut between words, and the row of each part."""
    cuts, owners = [offsets[:-1]], [np.arange(len(offsets) - 1)]
    for row in np.flatnonzero(np.diff(offsets) > limit).tolist():
        at, end = int(offsets[row]), int(offsets[row + 1])
        while end - at > limit:
            at += limit
            while at < end:
                gap = np.flatnonzero(~tk.ALNUM[tk.LOWER[data[at:min(end, at + 4096)]]])
                if len(gap):
                    at += int(gap[0])
                    break
                at = min(end, at + 4096)
            if at < end:
                cuts.append(np.array([at]))
                owners.append(np.array([row]))
    at, row = np.concatenate(cuts), np.concatenate(owners)
    order = np.argsort(at, kind="stable") if len(cuts) > 1 else slice(None)
    return np.append(at[order], offsets[-1]), row[order]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct (item_id, term) pairs."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    return items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def sharing_plans(pairs: DataFrame) -> DataFrame:
    """One row per block of (block, item_id, term) pairs: its items and plan."""
    numbers = ArrayType(LongType())
    schema = StructType([StructField("block", LongType()), StructField("items", ArrayType(pairs.schema["item_id"].dataType)),
                         StructField("terms", ArrayType(StringType())),
                         *[StructField(n, numbers) for n in ("leaf", "left", "right", "rounds", "nodes", "starts")]])

    def plan(block: pa.Table) -> pa.Table:
        ids = block.column("item_id").combine_chunks()
        coded = ids.dictionary_encode(null_encoding="encode")
        p = mine(np.array(coded.indices), np.array(block.column("term").to_pylist(), object), len(coded.dictionary))
        row = [block.column("block")[0].as_py(), coded.dictionary.to_pylist(), p.terms,
               *[getattr(p, n).tolist() for n in ("leaf", "left", "right", "rounds", "nodes", "starts")]]
        return pa.table([pa.array([v], t) for v, t in zip(row, arrow)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema).types
    return pairs.groupBy("block").applyInArrow(plan, schema)


def postings(rows: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms of the document), and numbers and counts of the
    given terms in it, ascending; documents without any term have no row."""
    kind, seen = rows.schema["doc_id"].dataType.simpleString(), {}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not seen:
            seen["table"] = TermTable(terms)
        table, width = seen["table"], max(1, len(terms))
        for b in batches:
            data, whole = string_buffers(b.column(1))
            offsets, owner = cut_rows(data, whole, CHUNK)
            n, keys, counts = np.zeros(b.num_rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in row_chunks(offsets, CHUNK):
                part = tk.LOWER[data[offsets[lo]:offsets[hi]]]
                s, e, r = tk.spans(part, offsets[lo:hi + 1] - offsets[lo], tk.ALNUM)
                r = owner[lo:hi][r]
                n += np.bincount(r, minlength=b.num_rows)
                t = table.find(part, s, e)
                key, count = np.unique((r * width + t)[t >= 0], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int32)
            stay = np.flatnonzero(n)
            at = pa.array(np.searchsorted(key, np.append(stay, b.num_rows) * width), pa.int32())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(stay)), pa.array(n[stay]), pa.ListArray.from_arrays(at, pa.array((key % width).astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(count))], names=["doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(post, f"doc_id {kind}, {POSTINGS}")


class _Best:
    """The ``k`` best documents of each item in one task."""

    def __init__(self, n_items: int, k: int, kind: pa.DataType) -> None:
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.rows = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], names=["item", "score", "doc_id"])]
        self.held = 0

    def offer(self, scores: np.ndarray, docs: pa.Array) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if len(item):
            self.rows.append(pa.table([pa.array(item), pa.array(scores[item, doc]), docs.take(pa.array(doc))], names=["item", "score", "doc_id"]))
            self.held += len(item)
            if self.held > HELD:
                self.cut()

    def cut(self) -> pa.Table:
        t = pa.concat_tables(self.rows)
        t = t.take(pc.sort_indices(t, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
        item = t.column("item").to_numpy()
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        t = t.filter(pa.array(rank < self.k)).combine_chunks()
        last = rank[rank < self.k] == self.k - 1
        self.least[t.column("item").to_numpy()[last]] = t.column("score").to_numpy()[last]
        self.rows, self.held = [t], 0
        return t


def best_in_tasks(found: DataFrame, plan: SharingPlan, items: pa.Array, weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """item_id, score, doc_id: each task's ``k`` best documents of each item."""
    kind = found.schema["doc_id"].dataType.simpleString()
    step = max(1, CELLS // (plan.n_leaves + len(plan.left) + len(plan.nodes) + len(plan.starts)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if best is None:
                best = _Best(len(plan.starts), k, b.column(0).type)
            n = b.column(1).to_numpy()
            m = 100 - 50 + np.array([50 * x * docs // length for x in n.tolist()], np.int64)
            at = b.column(2).offsets.to_numpy().astype(np.int64)
            size = np.diff(at)
            term, count = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.int64)
            at, doc = at - at[0], np.repeat(np.arange(len(n)), size)
            value = weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))
            leaf = plan.leaf[term]
            for lo in range(0, len(n), step):
                hi = min(lo + step, len(n))
                a, z = at[lo], at[hi]
                leaves = np.zeros((plan.n_leaves, hi - lo), np.int64)
                if a < z:
                    run = np.flatnonzero(np.append(True, (np.diff(leaf[a:z]) != 0) | (np.diff(doc[a:z]) != 0)))
                    leaves[leaf[a:z][run], doc[a:z][run] - lo] = np.add.reduceat(value[a:z], run)
                best.offer(plan.evaluate(leaves), b.column(0).slice(lo, hi - lo))
        if best is not None:
            t = best.cut()
            yield from pa.table([items.take(t.column("item").combine_chunks()), t.column("score"), t.column("doc_id")],
                                names=["item_id", "score", "doc_id"]).to_batches()

    from pyspark.sql.pandas.types import from_arrow_type
    return found.mapInArrow(score, StructType([StructField("item_id", from_arrow_type(items.type)), StructField("score", LongType()),
                                              StructField("doc_id", found.schema["doc_id"].dataType)]))


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs, id_col, text_col)
    pairs = written(item_terms(items, item_id_col, item_text_col), "search-pairs")
    blocks = max(1, -(-pairs.count() // block))
    dealt = pairs.select(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), "item_id", "term")
    plans = written(sharing_plans(dealt), "search-plans")
    parts = []
    for (number,) in plans.select("block").orderBy("block").collect():
        row = plans.where(F.col("block") == number).toArrow()
        as_np = {n: np.array(row.column(n)[0].values, np.int64) for n in ("leaf", "left", "right", "rounds", "nodes", "starts")}
        plan = SharingPlan(row.column("terms")[0].as_py(), **as_np)
        found = written(postings(rows, plan.terms), "search-postings")
        docs_n, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not docs_n:
            continue
        held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * docs_n + 2) / (2 * F.col("df") + 1))).cast("long")
        known = held.select("term", weight.alias("w")).toArrow()
        weights = np.zeros(len(plan.terms), np.int64)
        weights[known.column("term").to_numpy()] = known.column("w").to_numpy()
        plan.terms = []
        parts.append(best_in_tasks(found, plan, row.column("items")[0].values, weights, docs_n, length, k))
    if not parts:
        empty = StructType([pairs.schema["item_id"], StructField("score", LongType()), rows.schema["doc_id"]])
        parts = [spark.createDataFrame([], empty)]
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    # Tasks are first merged in about the square root of their number of groups.
    groups = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("at", F.spark_partition_id() % groups)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "at").orderBy(*order))).where(F.col("rank") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
