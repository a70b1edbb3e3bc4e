"""Operator 4, benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task (about ``SHARD`` words). Its words
become numbers, an FM-index is built over them, and all test phrases are
searched backwards through the wavelet ranks at once; the suffix rows found are
located by sampled positions, and overlapping occurrences are merged into
removal spans. Documents longer than a shard are indexed in pieces that overlap
by a phrase, so memory does not depend on the longest document.

The phrases go to the tasks in blocks of at most ``BLOCK`` words (the bound of
what is sent; a longer item is dealt over several blocks): one pass over the documents per block, results of several
passes are merged by row. A benchmark that fits in one block needs no shuffle.

Words are compared by a 64-bit hash.

Defined results: a null text has no words; a null item id counts as ''; an item
repeated with its id counts once; a document without words is clean; null ids
and repeated rows each get their row; an empty benchmark leaves every document
clean; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from parley.llm import tokens as tk
from parley.llm.common import prepare, row_chunks, rowed, string_buffers, texts, written
from parley.llm.fm_index import FMIndex

WINDOW = 10
SHARD = 1 << 19
BLOCK = 1 << 21
CHUNK = 4 << 20

SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()),
                   StructField("first_byte", LongType()), StructField("end_byte", LongType())])


def word_hashes(text: str) -> np.ndarray:
    data = tk.LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    s, e, _ = tk.spans(data, np.array([0, len(data)]), tk.ALNUM)
    return tk.hashes(data, s, e)


def phrase_blocks(items: Iterator[tuple[str, str]], window: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Blocks of (phrases as rows of word hashes, their lengths' mask as zeros
    in front, item of each phrase)."""
    rows, who, names, held = [], [], [], 0
    room = max(1, limit // window)

    def block():
        return np.concatenate([r for r, _ in rows]), np.concatenate([u for _, u in rows]), np.concatenate(who), names

    for name, text in items:
        h = word_hashes(text)
        if not len(h):
            continue
        if len(h) < window:
            got = np.zeros((1, window), np.uint64)
            got[0, window - len(h):] = h
        else:
            got = np.lib.stride_tricks.sliding_window_view(h, window)
        lo = 0
        while lo < len(got):
            part = got[lo:lo + room - held]
            # Zero marks the unused front places; no word hashes to it in practice, and a shorter row is told by ``used``.
            rows.append((part, np.full(len(part), min(len(h), window))))
            who.append(np.full(len(part), len(names)))
            names.append(name)
            held += len(part)
            lo += len(part)
            if held >= room:
                yield block()
                rows, who, names, held = [], [], [], 0
    if rows:
        yield block()


def shards(counts: np.ndarray, size: int, overlap: int) -> Iterator[list[tuple[int, int]]]:
    """Groups of (first word, words) pieces, each group about ``size`` words.
    A row with more words is cut into pieces that overlap."""
    group, total, begin = [], 0, 0
    for n in counts.tolist():
        lo = 0
        while lo < n:
            take = min(n - lo, size)
            if group and total + take > size:
                yield group
                group, total = [], 0
            group.append((begin + lo, take))
            total += take
            if lo + take >= n:
                break
            lo += take - overlap
        begin += n
    if group:
        yield group


def occurrences(h: np.ndarray, counts: np.ndarray, phrases: np.ndarray, used: np.ndarray, size: int = SHARD):
    """(first word, words, phrase) of every place where a phrase occurs; h:
    word hashes of all rows, counts: words of each row."""
    window = phrases.shape[1]
    place, which = [], []
    for group in shards(counts, max(size, 4 * window), window - 1):
        words = np.concatenate([h[a:a + n] for a, n in group])
        vocab, number = np.unique(words, return_inverse=True)
        symbols = np.zeros(len(words) + len(group), np.uint32)
        ends = np.cumsum([n for _, n in group])
        starts = ends - [n for _, n in group] + np.arange(len(group))
        inside = np.ones(len(symbols), bool)
        inside[ends + np.arange(len(group))] = False
        symbols[inside] = number + 1
        at = np.minimum(np.searchsorted(vocab, phrases), len(vocab) - 1)
        pattern = np.where(vocab[at] == phrases, at + 1, 0)
        pattern[np.arange(window)[None, :] < (window - used)[:, None]] = -1
        possible = np.flatnonzero((pattern != 0).all(axis=1))
        if not len(possible):
            continue
        index = FMIndex(symbols, len(vocab))
        lo, hi = index.search(pattern[possible])
        found = hi - lo
        rows = np.repeat(lo, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        where = index.locate(rows)
        piece = np.searchsorted(starts, where, side="right") - 1
        place.append(np.array([a for a, _ in group])[piece] + where - starts[piece])
        which.append(np.repeat(possible, found))
    if not place:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(place), np.concatenate(which)


def scan_chunk(data: np.ndarray, offsets: np.ndarray, block, size: int = SHARD):
    """Words of each row, merged spans (row, first word, end word, first byte,
    end byte) and the (row, item) pairs."""
    phrases, used, who, _ = block
    low = tk.LOWER[data]
    s, e, row = tk.spans(low, offsets, tk.ALNUM)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    h = tk.hashes(low, s, e)
    place, which = occurrences(h, counts, phrases, used, size)
    step = np.zeros(len(s) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + used[which], -1)
    hit = np.cumsum(step)[:-1] > 0
    # Merge: a span is a run of hit words inside one row.
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    end[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    r = row[a]
    spans = (r, a - first[r], b + 1 - first[r], s[a] - offsets[r], e[b] - offsets[r])
    return counts, spans, np.unique(row[place].astype(np.int64) << 32 | who[which])


def _pass(rows: DataFrame, block, keep_row: bool, size: int) -> DataFrame:
    names = block[3]
    fields = [*(rows.schema[c] for c in (["row"] if keep_row else []) + ["doc_id"]), StructField("n_words", LongType()),
              StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(StringType()))]
    schema = StructType(fields)
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in SPAN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_buffers(b.column(0))
            for lo, hi in row_chunks(offsets, CHUNK):
                n = hi - lo
                counts, (r, *ends), pairs = scan_chunk(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], block, size)
                spans: list[list] = [[] for _ in range(n)]
                for x, *v in zip(r.tolist(), *(c.tolist() for c in ends)):
                    spans[x].append(dict(zip(SPAN.names, v)))
                items: list[list[str]] = [[] for _ in range(n)]
                for p in pairs.tolist():
                    items[p >> 32].append(names[p & 0xFFFFFFFF])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, n) for c in b.columns[1:]), pa.array(counts, pa.int64()), pa.array(spans, kind),
                     pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return rows.select("text", *(["row"] if keep_row else []), "doc_id").mapInArrow(run, schema)


def _merge(spans: Column) -> Column:
    """Sorted spans with overlapping ones joined (only after several passes)."""
    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
                          last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], x["end_byte"]).alias("end_byte"))
        return F.when((F.size(done) > 0) & (x["start"] <= last["end"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(ArrayType(SPAN)), step)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, shard: int = SHARD,
                   id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (merged, in words and
    bytes), items (ids of items with occurring windows), and with ``row_col``
    that column as row."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                             F.coalesce("text", F.lit("")).alias("t"))
    blocks = phrase_blocks(((r["i"], r["t"]) for r in items.toLocalIterator()), window, block)
    current = next(blocks, None)
    if current is None:
        z = np.zeros(0, np.int64)
        current = (np.zeros((0, window), np.uint64), z, z, [])
    following = next(blocks, None)
    carry_row = row_col is not None
    if following is None:
        return _pass(texts(docs, id_col, text_col, row_col), current, carry_row, shard).withColumn("items", F.array_distinct("items"))
    rows = texts(docs if carry_row else rowed(docs, "row_"), id_col, text_col, row_col or "row_")
    passes = [written(_pass(rows, current, True, shard), "decontaminate-pass")]
    while following is not None:
        passes.append(written(_pass(rows, following, True, shard), "decontaminate-pass"))
        following = next(blocks, None)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    out = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                   F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return out.select(*(["row"] if carry_row else []), "doc_id", "n_words", _merge(F.col("spans")).alias("spans"), F.array_distinct("items").alias("items"))


def decontamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The found spans with their counts: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, spans."""
    found = find_benchmark(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.withColumn("n_hit", hit).select(
        *(["row"] if "row" in found.columns else []), "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast(BinaryType()), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans")


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without its removal spans, joined by single spaces."""
    raw = text.cast("binary")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(spans, lambda x: F.array(x["first_byte"], x["end_byte"]))),
                     F.array(F.length(raw).cast("long")))
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.trim(F.decode(
        F.substring(raw, (edges[2 * i] + 1).cast("int"), (edges[2 * i + 1] - edges[2 * i]).cast("int")), "UTF-8")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.filter(pieces, lambda p: p != ""), " "))
