"""Operator 1, LM scoring with a hierarchical Pitman-Yor bigram model.

Each word is the context of a restaurant; all context restaurants share one
parent, the unigram restaurant, whose base is uniform over the V known words
and one unknown. Seats are sampled by Gibbs sweeps (``pitman_yor``), and the
score of a text sums log10 of its tokens' predictive probabilities averaged
over the kept sweeps. The context of a text's first token is the end token.

How it runs. Words are 64-bit hashes. A tokenising pass writes chunks of
documents (about ``CHUNK`` bytes) as files in the shared folder, named in a
manifest that Spark commits. From then on only compact arrays are shuffled, one
row per (chunk, bucket): counts of the chunk's distinct words go to word
buckets, counts of its distinct word pairs to pair buckets, and the answers go
back to the chunk. Buckets come from a hash of the word, or of both words of a
pair, and their number grows with the corpus; a context that holds a third of
all tokens is spread over all pair buckets. A pair seen once always sits alone,
so sweeps touch only pairs seen more often. Within a sweep all pair buckets
work with the parent probabilities and table totals of the sweep before (as
distributed Gibbs samplers do); word buckets then add up the tables sent by
the pair buckets, redraw the unigram seats and send new probabilities.

Nothing is collected but counts per bucket. Every step's result is a written
table, so a lost executor repeats one step at most.

Defined results: a null text is empty and has one token, the end; a null id
counts as '' in choosing held-out rows; repeated rows each count and get their
row; without training rows every token is unknown; an empty table gives an
empty result; other columns are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from parley.llm import tokens as tk
from parley.llm.common import drop, prepare, remainder, scratch_path, string_buffers, texts, written
from parley.llm.pitman_yor import DISCOUNT, draw_tables, predict
from parley.llm.token_files import _folder, _local, open_new

CHUNK = 5 << 20
WORDS_A_BUCKET = 1_500_000
PAIRS_A_BUCKET = 3_000_000
BURN_IN = 1
KEPT = 2
STRENGTH = 1.0
END = np.uint64(1)  # the end token's number; no word's hash in practice
_U = np.uint64


# --- arrays as blobs ---------------------------------------------------------

def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Bytes of an array: differences if ascending, equal bytes side by side,
    compressed."""
    if ascending and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes, kind: str, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(blob[8:], n, "zstd", asbytes=True), np.uint8)
    size = np.dtype(kind).itemsize
    a = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=a.dtype) if ascending else a


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Consecutive rows with the same first column."""
    key, rows, begun = None, [], False
    for b in batches:
        for r in b.to_pylist():
            k = r[b.schema.names[0]]
            if begun and k != key:
                yield key, rows
                rows = []
            key, begun = k, True
            rows.append(r)
    if begun:
        yield key, rows


def together(df: DataFrame, key: str, *then: str, n: int | None = None) -> DataFrame:
    """Rows of a key in one place and in order; ``key`` becomes the first
    column. ``n``: the keys are bucket numbers below it, a task for each."""
    rows = df.select(key, *(c for c in df.columns if c != key))
    rows = rows.repartitionById(n, key) if n else rows.repartition(key)
    return rows.sortWithinPartitions(key, *then)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# --- chunks ------------------------------------------------------------------

def _write_chunk(path: str, doc_ids: pa.Array, held: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple:
    s, e, row = tk.spans(data, offsets, tk.NOT_SPACE)
    n = len(offsets) - 1
    h = tk.hashes(data, s, e)
    h[h == END] += _U(1)
    size = np.bincount(row, minlength=n) + 1
    stop = np.cumsum(size)
    all_ = np.full(int(size.sum()), END, np.uint64)
    inside = np.ones(len(all_), bool)
    inside[stop - 1] = False
    all_[inside] = h
    vocab, tokens = np.unique(all_, return_inverse=True)
    learn = np.repeat(~held, size)
    count = np.bincount(tokens[learn], minlength=len(vocab))
    name = f"{path}/chunk-{uuid.uuid4().hex}"
    t = pa.table({"doc_id": pa.array([doc_ids.to_pylist()], pa.list_(doc_ids.type)), "held": [held.tolist()],
                  "size": [pack(size.astype("<i4"))], "vocab": [pack(vocab, True)], "count": [pack(count.astype("<i4"))],
                  "tokens": [pack(tokens.astype("<u4"))]})
    with open_new(name) as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    return name, n, len(all_), int(learn.sum()), len(vocab)


class Chunk:
    def __init__(self, name: str) -> None:
        if path := _local(name):
            with pa.OSFile(path) as f:
                t = pa.ipc.open_file(f).read_all()
        else:
            from pyarrow import fs
            store, path = fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as f:
                t = pa.ipc.open_file(f).read_all()
        self.doc_id = t["doc_id"].chunk(0).flatten()
        self.held = np.array(t["held"][0].as_py(), bool)
        get = {k: t[k][0].as_py() for k in ("size", "vocab", "count", "tokens")}
        self.size = unpack(get["size"], "<i4").astype(np.int64)
        self.vocab = unpack(get["vocab"], "<u8", True)
        self.count = unpack(get["count"], "<i4").astype(np.int64)
        self.tokens = unpack(get["tokens"], "<u4").astype(np.int64)

    def places(self, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Places in the vocabulary of each word bucket's words."""
        b = word_bucket(self.vocab, n_buckets)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(n_buckets + 1))
        for k in range(n_buckets):
            if cut[k] < cut[k + 1]:
                yield k, order[cut[k]:cut[k + 1]]

    def pairs(self, ids: np.ndarray):
        """Distinct pairs of known words: global ids, training count, and for
        each token its pair (-1: a word of it is unknown). In order of the ids."""
        end = int(np.searchsorted(self.vocab, END))
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.size) - self.size] = end
        known = (ids[before] >= 0) & (ids[self.tokens] >= 0)
        key, back = np.unique(before[known] << 32 | self.tokens[known], return_inverse=True)
        learn = np.repeat(~self.held, self.size)[known]
        count = np.bincount(back[learn], minlength=len(key))
        u, w = ids[key >> 32], ids[key & 0xFFFFFFFF]
        order = pair_order(u, w)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = np.full(len(self.tokens), -1)
        of[known] = rank[back]
        return before, u[order], w[order], count[order], of


def word_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(h ^ _U(0x5851F42D4C957F2D)) % _U(n)).astype(np.int64)


def pair_bucket(u: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(u.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + w.astype(np.uint64)) % _U(n)).astype(np.int64)


def pair_order(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    if len(u) and max(u.max(), w.max()) >> 32:
        return np.lexsort((w, u))
    return np.argsort(u << 32 | w, kind="stable")


def _by_pair_bucket(u, w, n: int) -> Iterator[tuple[int, np.ndarray]]:
    b = pair_bucket(u, w, n)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(n + 1))
    for k in range(n):
        if cut[k] < cut[k + 1]:
            yield k, order[cut[k]:cut[k + 1]]


def tokenise(docs: DataFrame, path: str, modulus: int, held: int, id_col: str, text_col: str) -> DataFrame:
    """Write chunk files; the manifest has one row per chunk."""
    rows = texts(docs, id_col, text_col).withColumn("held", remainder(F.col("doc_id"), modulus) == held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.string()), *((k, pa.int64()) for k in ("n_docs", "n_tokens", "n_train", "n_vocab"))])
        ids, flags, parts, sizes, total = [], [], [], [], 0

        def done():
            data = tk.LOWER[np.concatenate(parts)]
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return table_of([_write_chunk(path, pa.concat_arrays(ids), np.concatenate(flags), data, offsets)], schema)

        for b in batches:
            data, offsets = string_buffers(b.column(1))
            flag = np.array(b.column(2).to_pylist(), bool)
            lo, n = 0, b.num_rows
            while lo < n:
                hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK - total, side="right")) - 1
                hi = min(max(hi, lo + 1), n)
                ids.append(b.column(0).slice(lo, hi - lo))
                flags.append(flag[lo:hi])
                parts.append(data[offsets[lo]:offsets[hi]].copy())
                sizes.append(np.diff(offsets[lo:hi + 1]))
                total += int(offsets[hi] - offsets[lo])
                if total >= CHUNK // 2 and hi < n or total >= CHUNK:
                    yield done()
                    ids, flags, parts, sizes, total = [], [], [], [], 0
                lo = hi
        if ids:
            yield done()

    return rows.mapInArrow(run, "chunk string, n_docs long, n_tokens long, n_train long, n_vocab long")


# --- the model ---------------------------------------------------------------

_ROW = "bucket int, other int, chunk string, n long, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("other", pa.int32()), ("chunk", pa.string()), ("n", pa.int64()),
                     *((k, pa.binary()) for k in "abcd")])


class Model:
    """The steps of one run; each gives a written table."""

    def __init__(self, docs: DataFrame, modulus: int, held: int, id_col: str, text_col: str, burn_in: int, kept: int,
                 strength: float, seed: int, words_a_bucket: int, pairs_a_bucket: int) -> None:
        self.strength, self.seed, self.burn_in, self.kept = strength, seed, burn_in, kept
        spark = docs.sparkSession
        path = _folder(spark, scratch_path(spark, "lm-chunks"))
        self.id_type = texts(docs, id_col, text_col).schema["doc_id"].dataType
        self.manifest = written(tokenise(docs, path, modulus, held, id_col, text_col), "lm-manifest")
        total = self.manifest.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "n_vocab"))).first()
        self.n_train = total["n_train"]
        self.word_buckets = 1 + total["n_vocab"] // words_a_bucket
        self.pair_buckets = 1 + total["n_tokens"] // pairs_a_bucket
        self.vocabulary()
        self.count_pairs()
        self.sample()

    def vocabulary(self) -> None:
        """Word rows (chunk null: n known words, a: their counts) and answers
        to chunks (a: counts of the chunk's words, b: their places, or -1)."""
        n = self.word_buckets

        def send(batches):
            for b in batches:
                for name in b.column(0).to_pylist():
                    c = Chunk(name)
                    yield table_of([(k, 0, name, len(at), pack(c.vocab[at], True), pack(c.count[at].astype("<i4")), None, None)
                                    for k, at in c.places(n)], _SCHEMA)

        def add(batches):
            for bucket, rows in groups(batches):
                words = [unpack(r["a"], "<u8", True) for r in rows]
                found, back = np.unique(np.concatenate(words), return_inverse=True)
                count = np.bincount(back, weights=np.concatenate([unpack(r["b"], "<i4") for r in rows]), minlength=len(found)).astype(np.int64)
                place = np.where(count > 0, np.cumsum(count > 0) - 1, -1)
                yield table_of([(bucket, 0, None, int((count > 0).sum()), pack(count[count > 0].astype("<i8")), None, None, None)], _SCHEMA)
                at = 0
                for r, w in zip(rows, words):
                    mine = back[at:at + len(w)]
                    at += len(w)
                    yield table_of([(bucket, 0, r["chunk"], len(w), pack(count[mine].astype("<i8")), pack(place[mine].astype("<i8")), None, None)], _SCHEMA)

        # A fixed number of tasks: by its size the list of chunks would go to one.
        chunks = self.manifest.select("chunk").repartition(max(1, self.manifest.count()), "chunk")
        self.words = written(together(chunks.mapInArrow(send, _ROW), "bucket", "chunk", n=n).mapInArrow(add, _ROW), "lm-words")
        sizes = {r["bucket"]: r["n"] for r in self.words.where("chunk IS NULL").select("bucket", "n").collect()}  # one number per bucket
        self.base = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(n)])]).astype(np.int64)
        self.v = int(self.base[-1])

    def count_pairs(self) -> None:
        """Pair rows (chunk null: n pairs seen more than once, a: contexts, b:
        words, c: counts), word rows (other >= 0: word bucket; a: places of its
        words that the pair bucket needs, b: pairs seen once by context, c: by
        word) and answers to chunks (a: counts, b: place among the pairs seen
        more than once)."""
        n_words, n, base = self.word_buckets, self.pair_buckets, self.base

        def send(batches):
            for name, rows in groups(batches):
                c = Chunk(name)
                ids = local_ids(c, rows, n_words, base)[0]
                _, u, w, count, _ = c.pairs(ids)
                yield table_of([(k, -1, name, len(at), pack(u[at], True), pack(w[at]), pack(count[at].astype("<i4")), None)
                                for k, at in _by_pair_bucket(u, w, n)], _SCHEMA)

        def add(batches):
            for bucket, rows in groups(batches):
                us = np.concatenate([unpack(r["a"], "<i8", True) for r in rows])
                ws = np.concatenate([unpack(r["b"], "<i8") for r in rows])
                count = np.concatenate([unpack(r["c"], "<i4") for r in rows]).astype(np.int64)
                order = pair_order(us, ws)
                u, w = us[order], ws[order]
                new = np.ones(len(u), bool)
                new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
                of = np.cumsum(new) - 1
                total = np.bincount(of, weights=count[order], minlength=int(new.sum())).astype(np.int64)
                u, w = u[new], w[new]
                back = np.empty(len(order), np.int64)
                back[order] = of
                del us, ws, order, of
                many, once = total > 1, total == 1
                place = np.cumsum(many) - 1
                yield table_of([(bucket, -1, None, int(many.sum()), pack(u[many], True), pack(w[many]), pack(total[many]), None)], _SCHEMA)
                ids = np.unique(np.concatenate([u[many | once], w[many | once]]))
                by_u = np.bincount(np.searchsorted(ids, u[once]), minlength=len(ids))
                by_w = np.bincount(np.searchsorted(ids, w[once]), minlength=len(ids))
                cut = np.searchsorted(ids, base)
                for k in range(n_words):
                    a, z = cut[k], cut[k + 1]
                    if a < z:
                        yield table_of([(bucket, k, None, int(z - a), pack(ids[a:z] - base[k], True), pack(by_u[a:z].astype("<i4")),
                                         pack(by_w[a:z].astype("<i4")), None)], _SCHEMA)
                at = 0
                for r in rows:
                    mine = back[at:at + r["n"]]
                    at += r["n"]
                    got = total[mine]
                    yield table_of([(bucket, -1, r["chunk"], r["n"], pack(got.astype("<u4") if not got.max(initial=0) >> 32 else got), pack(place[mine[got > 1]], True), None, None)], _SCHEMA)

        answers = self.words.where("chunk IS NOT NULL")
        sent = together(answers, "chunk", "bucket").mapInArrow(send, _ROW)
        self.pairs = written(together(sent, "bucket", "chunk", n=n).mapInArrow(add, _ROW), "lm-pairs")

    def sample(self) -> None:
        """Sweeps. ``asked`` rows go between the buckets: to the word buckets
        (tables by context and by word) and back (tables of a context, parent
        probability of a word)."""
        base, v, strength, seed = self.base, self.v, self.strength, self.seed
        n_words, n_pairs = self.word_buckets, self.pair_buckets
        counts = self.words.where("chunk IS NULL").select(F.col("bucket"), F.lit(-1).alias("other"), F.col("chunk"), "n", "a", "b", "c", "d")
        links = self.pairs.where("chunk IS NULL AND other >= 0")
        state = self.pairs.where("chunk IS NULL AND other < 0")
        flip = F.col("other").alias("bucket"), F.col("bucket").alias("other")

        def seat_words(sweep: int, unigram_tables: float, customers: float):
            """Word bucket: adds the tables sent by pair buckets, redraws the
            unigram seats, answers every pair bucket; its own row (other -1)
            has tables by context, customers and tables of each word."""
            def run(batches):
                for bucket, rows in groups(batches):
                    n = next(r["n"] for r in rows if r["other"] < 0)
                    by_u, by_w = np.zeros(n), np.zeros(n)
                    places = []
                    for r in rows:
                        if r["other"] >= 0:
                            at = unpack(r["a"], "<i8", True)
                            places.append((r["other"], at))
                            by_u[at] += unpack(r["b"], "<i4")
                            by_w[at] += unpack(r["c"], "<i4")
                    rng = np.random.default_rng([seed, sweep, 0, bucket])
                    g = np.full(n, (strength + DISCOUNT * unigram_tables) / (v + 1))
                    t = np.where(by_w > 0, draw_tables(np.maximum(by_w, 1).astype(np.int64), g, rng), 0)
                    yield table_of([(bucket, -1, None, n, pack(by_u.astype("<i8")), pack(by_w.astype("<i8")), pack(t.astype("<i8")),
                                     np.array([by_w.sum(), t.sum()]).tobytes())], _SCHEMA)
                    for k, at in places:
                        yield table_of([(bucket, k, None, len(at), pack(by_u[at].astype("<i4")), pack(by_w[at].astype("<i4")),
                                         pack(t[at].astype("<i4")), None)], _SCHEMA)
            return run

        def seat_pairs(sweep: int, unigram_tables: float, customers: float):
            """Pair bucket: redraws the tables of its pairs from the word
            buckets' answers (``from`` rows); its own row (other -1) has the
            tables in d."""
            def run(batches):
                for bucket, rows in groups(batches):
                    own = next(r for r in rows if r["other"] < 0)
                    u, w, c = unpack(own["a"], "<i8", True), unpack(own["b"], "<i8"), unpack(own["c"], "<i8")
                    link = {r["other"]: r for r in rows if r["other"] >= 0 and r["d"] == b"link"}
                    told = {r["other"]: r for r in rows if r["other"] >= 0 and r["d"] is None}
                    keys = sorted(link)
                    places = [unpack(link[k]["a"], "<i8", True) for k in keys]
                    ids = np.concatenate([p + base[k] for k, p in zip(keys, places)] or [np.zeros(0, np.int64)])

                    def join(col: str) -> np.ndarray:
                        return np.concatenate([unpack(told[k][col], "<i4") for k in keys] or [np.zeros(0)]).astype(float)

                    parent = predict(join("b"), join("c"), strength, customers, unigram_tables, 1 / (v + 1))
                    iu, iw = np.searchsorted(ids, u), np.searchsorted(ids, w)
                    g = (strength + DISCOUNT * join("a")[iu]) * parent[iw]
                    t = draw_tables(c, g, np.random.default_rng([seed, sweep, 1, bucket]))
                    yield table_of([(bucket, -1, None, len(t), own["a"], own["b"], own["c"], pack(t))], _SCHEMA)
                    by_u = np.bincount(iu, weights=t, minlength=len(ids)) + np.concatenate([unpack(link[k]["b"], "<i4") for k in keys] or [np.zeros(0)])
                    by_w = np.bincount(iw, weights=t, minlength=len(ids)) + np.concatenate([unpack(link[k]["c"], "<i4") for k in keys] or [np.zeros(0)])
                    at = 0
                    for k, p in zip(keys, places):
                        z = at + len(p)
                        yield table_of([(bucket, k, None, len(p), link[k]["a"], pack(by_u[at:z].astype("<i4")), pack(by_w[at:z].astype("<i4")), None)], _SCHEMA)
                        at = z
            return run

        def first_tables(batches):
            """At the start every pair sits at one table."""
            for bucket, rows in groups(batches):
                own = next(r for r in rows if r["other"] < 0)
                u, w = unpack(own["a"], "<i8", True), unpack(own["b"], "<i8")
                for r in rows:
                    if r["other"] >= 0:
                        k = r["other"]
                        ids = unpack(r["a"], "<i8", True) + base[k]
                        mine_u, mine_w = u[(u >= base[k]) & (u < base[k + 1])], w[(w >= base[k]) & (w < base[k + 1])]
                        by_u = unpack(r["b"], "<i4") + np.bincount(np.searchsorted(ids, mine_u), minlength=len(ids))
                        by_w = unpack(r["c"], "<i4") + np.bincount(np.searchsorted(ids, mine_w), minlength=len(ids))
                        yield table_of([(bucket, k, None, len(ids), r["a"], pack(by_u.astype("<i4")), pack(by_w.astype("<i4")), None)], _SCHEMA)

        def totals(words: DataFrame) -> tuple[float, float]:
            n, t = 0.0, 0.0
            for r in words.where("other < 0").select("d").collect():  # two numbers per bucket
                x = np.frombuffer(r["d"])
                n, t = n + x[0], t + x[1]
            return t, n

        sent = together(self.pairs.where("chunk IS NULL"), "bucket", "other", n=n_pairs).mapInArrow(first_tables, _ROW)
        self.samples: list[tuple[DataFrame, DataFrame, float, float]] = []
        tables, n = float(v), 0.0
        tagged = links.withColumn("d", F.lit(b"link"))
        old: list[DataFrame] = []
        for sweep in range(self.burn_in + self.kept + 1):
            incoming = sent.where("other >= 0").select(*flip, "chunk", "n", "a", "b", "c", "d").unionByName(counts)
            words = written(together(incoming, "bucket", "other", n=n_words).mapInArrow(seat_words(sweep, tables, n), _ROW), "lm-seats")
            tables, n = totals(words)
            if sweep > self.burn_in:
                self.samples.append((words.where("other < 0"), seats.where("other < 0"), tables, n))  # noqa: F821
            elif old:
                drop(*old)
                old = []
            if sweep == self.burn_in + self.kept:
                break
            answers = words.where("other >= 0").select(*flip, "chunk", "n", "a", "b", "c", "d")
            asked = state.unionByName(tagged).unionByName(answers)
            seats = written(together(asked, "bucket", "other", n=n_pairs).mapInArrow(seat_pairs(sweep, tables, n), _ROW), "lm-tables")
            sent = seats
            old += [words, seats] if sweep < self.burn_in else []

    def score(self) -> DataFrame:
        """One row per document of the chunks."""
        n_words, n_pairs, base, v, n_train, strength = self.word_buckets, self.pair_buckets, self.base, self.v, self.n_train, self.strength
        kept = len(self.samples)
        unigram = [(t, n) for _, _, t, n in self.samples]
        asks = self.words.where("chunk IS NOT NULL").select("bucket", F.lit(-1).alias("other"), "chunk", "n", "a", "b", "c", "d")
        for i, (words, _, _, _) in enumerate(self.samples):
            asks = asks.unionByName(words.withColumn("other", F.lit(i)))
        pair_asks = self.pairs.where("chunk IS NOT NULL")
        for i, (_, seats, _, _) in enumerate(self.samples):
            pair_asks = pair_asks.unionByName(seats.select("bucket", F.lit(i).alias("other"), "chunk", "n", F.col("d").alias("a"),
                                                           *(F.lit(None).cast("binary").alias(k) for k in "bcd")))

        def answer_words(batches):
            """To chunks: a: counts, b: places, c: per sample the tables of the
            context, d: per sample the parent probability."""
            for bucket, rows in groups(batches):
                seats = {r["other"]: r for r in rows if r["chunk"] is None}
                ctx = [unpack(seats[i]["a"], "<i8") for i in range(kept)]
                parent = [predict(unpack(seats[i]["b"], "<i8"), unpack(seats[i]["c"], "<i8"), strength, unigram[i][1], unigram[i][0], 1 / (v + 1))
                          for i in range(kept)]
                for r in rows:
                    if r["chunk"] is not None:
                        at = unpack(r["b"], "<i8")
                        at = at[at >= 0]
                        yield table_of([(bucket, 0, r["chunk"], r["n"], r["a"], r["b"], pack(np.concatenate([x[at] for x in ctx]).astype("<i4")),
                                         pack(np.concatenate([x[at] for x in parent]).astype("<f4")))], _SCHEMA)

        def answer_pairs(batches):
            """To chunks: a: counts, b: tables of the pairs seen more than
            once, one sample after the other."""
            for bucket, rows in groups(batches):
                seats = {r["other"]: unpack(r["a"], "<i8") for r in rows if r["chunk"] is None}
                for r in rows:
                    if r["chunk"] is not None:
                        at = unpack(r["b"], "<i8", True)
                        yield table_of([(bucket, 1, r["chunk"], r["n"], r["a"], pack(np.concatenate([seats[i][at] for i in range(kept)]).astype("<i4")), None, None)], _SCHEMA)

        to_chunks = (together(asks, "bucket", "chunk", "other", n=n_words).mapInArrow(answer_words, _ROW)
                     .unionByName(together(pair_asks, "bucket", "chunk", "other", n=n_pairs).mapInArrow(answer_pairs, _ROW)))
        schema = StructType([StructField("doc_id", self.id_type), StructField("held_out", BooleanType()),
                             *(StructField(k, LongType()) for k in ("n_tokens", "n_known", "train_tokens")),
                             StructField("base_score", DoubleType()), StructField("score", DoubleType())])

        def finish(batches):
            for name, rows in groups(batches):
                c = Chunk(name)
                word_rows = [r for r in rows if r["other"] == 0]
                pair_rows = {r["bucket"]: r for r in rows if r["other"] == 1}
                ids, count = local_ids(c, word_rows, n_words, base)
                ctx, parent = local_samples(c, word_rows, n_words, kept)
                before, u, w, _, of = c.pairs(ids)
                size = np.zeros(len(u), np.int64)
                seats = np.zeros((kept, len(u)))
                for k, at in _by_pair_bucket(u, w, n_pairs):
                    r = pair_rows[k]
                    size[at] = unpack(r["a"], "<u4" if int.from_bytes(r["a"][:8], "little") == 4 * len(at) else "<i8")
                    seats[:, at[size[at] == 1]] = 1
                    many = at[size[at] > 1]
                    seats[:, many] = unpack(r["b"], "<i4").reshape(kept, -1)
                paired = of >= 0
                prob = np.zeros(len(c.tokens))
                for i in range(kept):
                    tables, customers = unigram[i]
                    p1 = np.where(ids >= 0, parent[i], predict(0.0, 0.0, strength, customers, tables, 1 / (v + 1)))[c.tokens]
                    cu, tu = np.where(ids >= 0, count, 0)[before], np.where(ids >= 0, ctx[i], 0)[before]
                    cc, tt = np.zeros(len(of)), np.zeros(len(of))
                    cc[paired], tt[paired] = size[of[paired]], seats[i][of[paired]]
                    prob += predict(cc, tt, strength, cu, tu, p1)
                doc = np.repeat(np.arange(len(c.size)), c.size)
                n = len(c.size)
                plain = np.log10((count + 1) / (n_train + v + 1))[c.tokens]
                yield pa.RecordBatch.from_arrays([
                    c.doc_id, pa.array(c.held), pa.array(c.size), pa.array(np.bincount(doc, weights=count[c.tokens] > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, n_train)), pa.array(np.bincount(doc, weights=plain, minlength=n)),
                    pa.array(np.bincount(doc, weights=np.log10(prob / kept), minlength=n))], names=schema.names)

        return together(to_chunks, "chunk", "other", "bucket").mapInArrow(finish, schema)


def local_ids(c: Chunk, rows: list[dict], n: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Global id (-1: not in training) and training count of a chunk's words."""
    told = {r["bucket"]: r for r in rows}
    ids, count = np.full(len(c.vocab), -1, np.int64), np.zeros(len(c.vocab), np.int64)
    for k, at in c.places(n):
        place = unpack(told[k]["b"], "<i8")
        ids[at] = np.where(place >= 0, place + base[k], -1)
        count[at] = unpack(told[k]["a"], "<i8")
    return ids, count


def local_samples(c: Chunk, rows: list[dict], n: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables as a context and parent probability of a chunk's words, by sample."""
    told = {r["bucket"]: r for r in rows}
    ctx, parent = np.zeros((kept, len(c.vocab))), np.zeros((kept, len(c.vocab)))
    for k, at in c.places(n):
        at = at[unpack(told[k]["b"], "<i8") >= 0]
        ctx[:, at] = unpack(told[k]["c"], "<i4").reshape(kept, -1)
        parent[:, at] = unpack(told[k]["d"], "<f4").reshape(kept, -1)
    return ctx, parent


def lm_score(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text",
             burn_in: int = BURN_IN, kept: int = KEPT, strength: float = STRENGTH, seed: int = 1,
             words_a_bucket: int = WORDS_A_BUCKET, pairs_a_bucket: int = PAIRS_A_BUCKET) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    prepare(docs.sparkSession)
    return Model(docs, modulus, held, id_col, text_col, burn_in, kept, strength, seed, words_a_bucket, pairs_a_bucket).score()


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training texts, for the model and
    for the base."""
    def of(col: str):
        return F.pow(F.lit(10.0), -F.sum(col) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
