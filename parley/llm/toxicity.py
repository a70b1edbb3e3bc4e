"""Operator 3, toxicity: a linear classifier over character n-grams whose
features are scaled by naive Bayes log-count ratios.

Fitting uses a bounded sample of labelled rows (``BOUND``, a parameter): a
DataFrame aggregation counts, for each hashed n-gram, the toxic and the other
documents that hold it; the log ratio r of the smoothed shares is kept where it
lies ``MIN_Z`` standard errors from zero. Few labelled rows cannot reach that,
so the cut-off falls until at least the ``LEAST`` n-grams that lie farthest
from zero are kept (with all ties). A document's feature is r for each
kept n-gram it holds (present or not), and a logistic model with an L2 penalty
is fitted on these. Scoring is one pass over all texts without a shuffle: the
model is a table of fixed size.

Defined results: a null text is empty; a text without any kept n-gram gets the
model's intercept; without labelled rows every score is 0; null ids and
repeated rows each get their row; an empty table gives an empty result; other
columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parley.llm.common import drop, prepare, remainder, texts, written
from parley.llm.labelled import training_rows

SIZES = (4, 5)
BITS = 20
BOUND = 12_000
MIN_Z = 5.0
LEAST = 1000
SMOOTH = 1.0
PENALTY = 1e-3
STEPS = 250
THRESHOLD = 0.7
CHUNK = 2 << 20
_ODD = np.random.default_rng(7).integers(1, 1 << 32, (16, 16), dtype=np.uint32) | np.uint32(1)


def buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point."""
    m = len(codes) - n + 1
    h = np.zeros(max(m, 0), np.uint32)
    if m <= 0:
        return h
    for j in range(n):
        h += codes[j:j + m] * _ODD[n, j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS)


def code_chunks(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, row offsets) of lower-cased texts."""
    lo, part, size = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py().lower()
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield lo, *_codes(part)
            lo, part, size = i + 1, [], 0
    if part:
        yield lo, *_codes(part)


def _codes(part: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, part)])
    return np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def held_grams(codes: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None):
    """(row, bucket) of each n-gram that a row holds, once each. ``wanted``:
    a flag for each bucket."""
    keys = []
    for n in SIZES:
        b = buckets(codes, n)
        at = np.flatnonzero(wanted[b]) if wanted is not None else np.arange(len(b))
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + n <= offsets[row + 1] if len(at) else np.zeros(0, bool)
        keys.append(row[inside].astype(np.int64) << BITS | b[at[inside]])
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each bucket, for one task."""
    got = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        y = np.array(b.column(0).to_pylist(), np.int64)
        for lo, codes, offsets in code_chunks(b.column(1)):
            row, bucket = held_grams(codes, offsets, None)
            for label in (0, 1):
                got[label] += np.bincount(bucket[y[lo + row] == label], minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(got.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(got[0][at], pa.int32()),
                                      pa.array(got[1][at], pa.int32())], names=["bucket", "q", "p"])


def logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, k: int, penalty: float, steps: int):
    """Weights and intercept by Adam on the mean log loss plus the penalty."""
    n = len(y)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w, c = np.zeros(k + 1), np.log(share / (1 - share))
    w[k] = c
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col] * val, minlength=n) + w[k]
        e = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        g = np.append(np.bincount(col, weights=e[row] * val, minlength=k) / n + penalty * w[:k], e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:k], w[k]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, bound: int = BOUND,
        min_z: float = MIN_Z, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """(kept buckets, weight of each, intercept)."""
    sample = training_rows(docs, labels, "toxic", modulus, held, bound, id_col, text_col)
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n1 or not n0:
        drop(sample)
        return np.zeros(0, np.int64), np.zeros(0), (-50.0 if not n1 else 50.0)
    p = (F.col("p") + SMOOTH) / (n1 + 2 * SMOOTH)
    q = (F.col("q") + SMOOTH) / (n0 + 2 * SMOOTH)
    se = F.sqrt(1 / (F.col("p") + SMOOTH) + 1 / (F.col("q") + SMOOTH))
    # At most 2**BITS rows.
    grams = written(sample.select("y", "text").mapInArrow(_count, "bucket int, q int, p int")
                    .groupBy("bucket").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
                    .select("bucket", F.log(p / q).alias("r"), (F.abs(F.log(p / q)) / se).alias("z")), "toxic-grams")
    last = grams.orderBy(F.desc("z")).limit(least).agg(F.min("z").alias("z")).first()["z"]
    cut = min_z if last is None else min(min_z, last)
    ratio = grams.where(F.col("z") >= cut).orderBy("bucket").select("bucket", "r").toArrow()
    drop(grams)
    kept, r = ratio["bucket"].to_numpy().astype(np.int64), ratio["r"].to_numpy()
    wanted = np.zeros(1 << BITS, bool)
    wanted[kept] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, codes, offsets in code_chunks(b.column(1)):
                row, bucket = held_grams(codes, offsets, wanted)
                n = len(offsets) - 1
                cut = np.searchsorted(row, np.arange(n + 1))
                col = np.searchsorted(kept, bucket).astype("<i4")
                blobs = [col[a:z].tobytes() for a, z in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(blobs, pa.binary())], names=["y", "cols"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, cols = [], []
        for b in batches:
            ys += b.column(0).to_pylist()
            cols += [np.frombuffer(x.as_py(), "<i4") for x in b.column(1)]
        row = np.repeat(np.arange(len(ys)), [len(c) for c in cols])
        col = np.concatenate([*cols, np.zeros(0, "<i4")]).astype(np.int64)
        w, c = logistic(row, col, r[col], np.array(ys, float), len(kept), PENALTY, STEPS)
        yield pa.RecordBatch.from_arrays([pa.array([(w * r).astype("<f8").tobytes()], pa.binary()), pa.array([c])], names=["w", "c"])

    # The sample has at most ``bound`` rows, so one task can fit the model.
    best = (sample.select("y", "text").mapInArrow(features, "y int, cols binary").coalesce(1)
            .mapInArrow(train, "w binary, c double").first())
    drop(sample)
    return kept, np.frombuffer(best["w"], "<f8"), float(best["c"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = texts(docs, id_col, text_col)
    kept, weight, c = model
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << BITS)
        full[kept] = weight
        wanted = full != 0
        for b in batches:
            z = np.full(b.num_rows, c)
            for lo, codes, offsets in code_chunks(b.column(1)):
                row, bucket = held_grams(codes, offsets, wanted)
                n = len(offsets) - 1
                z[lo:lo + n] += np.bincount(row, weights=full[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=schema.names)

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD,
             bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, modulus, held, bound, id_col=id_col, text_col=text_col)
    return score(docs, model, id_col, text_col).select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
