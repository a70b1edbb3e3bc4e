"""Operator 9, quality: a linear-chain conditional random field labels every
line good or bad, and the length-weighted forward-backward marginals give the
document's quality.

Each line has its own features (length, shares of upper case, symbols and
digits, repeated words, repeated line, ...) and those of the lines before and
after it. Labels exist for documents only, so in fitting every line takes the
label of its document; the chain smooths that noise. The field is fitted on a
bounded sample of labelled rows (``BOUND``, a parameter) by gradient ascent on
the conditional likelihood, each document weighing the same. A logistic curve
fitted on the same sample turns the weighted mean of the marginals into a
score. Scoring is one pass over all texts without a shuffle.

Defined results: a null text is empty; a text without lines scores the share
of good documents in the sample, (good + 1) / (rows + 1), which is 1 without
labelled rows (then every document scores that); null ids and repeated rows
each get their row; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from parley.llm import tokens as tk
from parley.llm.common import drop, prepare, remainder, row_chunks, string_buffers, texts
from parley.llm.labelled import training_rows

BOUND = 8_000
STEPS = 120
PENALTY = 1e-3
THRESHOLD = 0.7
CHUNK = 4 << 20


def _bytes(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


IN_LINE = ~_bytes("\n")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
DIGIT = _bytes("0123456789")
PROSE = _bytes(".,;:?'\"()-")
SYMBOL = np.zeros(256, bool)
SYMBOL[0x21:0x7F] = True
SYMBOL &= ~(LETTER | DIGIT | PROSE)
ENDING = _bytes(".?!")
OWN = 12


def line_features(data: np.ndarray, offsets: np.ndarray):
    """Lines of the rows (runs of bytes other than newline): their features
    (own, previous, next), their length and their row."""
    s, e, row = tk.spans(data, offsets, IN_LINE)
    n = len(s)
    if n == 0:
        return np.zeros((0, 3 * OWN)), np.zeros(0), row
    size = (e - s).astype(float)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[data], s, dtype=np.int64).astype(float)

    letters = np.maximum(share(LETTER), 1)
    upper, symbol, digit = share(UPPER) / letters, share(SYMBOL) / size, share(DIGIT) / size
    low = tk.LOWER[data]
    ws, we, _ = tk.spans(low, offsets, tk.NOT_SPACE)
    line = np.searchsorted(s, ws, side="right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    h = tk.hashes(low, ws, we)
    again = np.zeros(len(ws), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeat = np.bincount(line, weights=again, minlength=n) / np.maximum(words, 1)
    mean = np.bincount(line, weights=we - ws, minlength=n) / np.maximum(words, 1)
    # A line seen before in its document: equal hash of row and bytes.
    whole = tk.mix(tk.hashes(data, s, e) ^ tk.mix(row.astype(np.uint64)))
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    seen = first[back] != np.arange(n)
    own = np.stack([np.ones(n), np.log1p(size) / 6, upper, symbol, digit, repeat, np.minimum(mean, 30) / 10,
                    ENDING[data[e - 1]], seen, upper > 0.5, symbol > 0.05, repeat > 0.2], axis=1).astype(float)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = row[1:] == row[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.hstack([own, before, after]), size, row


class Chains:
    """Ragged label chains, longest first, for vectorised recursions."""

    def __init__(self, sizes: np.ndarray) -> None:
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        self.begin, sizes = begin[order], sizes[order]
        self.longest = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(self.longest), side="left")

    def marginals(self, good: np.ndarray, step: np.ndarray):
        """P(good) of each line, and for each line but a chain's first the
        2 x 2 joint probability with the line before, summed by chain place.
        good: log weight of good against bad; step: 2 x 2 log weights."""
        psi = np.stack([np.ones(len(good)), np.exp(np.clip(good, -30, 30))], axis=1)
        move = np.exp(step)
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        for t in range(self.longest):
            at = self.begin[:self.active[t]] + t
            a = psi[at] if t == 0 else psi[at] * (alpha[at - 1] @ move)
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(self.longest - 1, 0, -1):
            at = self.begin[:self.active[t]] + t
            b = (psi[at] * beta[at]) @ move.T
            beta[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = alpha * beta
        p = both[:, 1] / both.sum(axis=1)
        return p, psi, alpha, beta, move

    def pairs(self, psi, alpha, beta, move, weight: np.ndarray) -> np.ndarray:
        """Weighted sum of the joint probabilities of neighbours."""
        first = np.zeros(len(psi), bool)
        first[self.begin] = True
        at = np.flatnonzero(~first)
        joint = alpha[at - 1][:, :, None] * move[None] * (psi[at] * beta[at])[:, None, :]
        joint *= (weight[at] / joint.sum(axis=(1, 2)))[:, None, None]
        return joint.sum(axis=0)


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return x


def fit_field(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = PENALTY):
    """Emission weights and 2 x 2 transition weights; y by document."""
    chains, k = Chains(sizes), x.shape[1]
    label = np.repeat(y, sizes).astype(float)
    weight = np.repeat(1 / sizes, sizes) / len(sizes)
    first = np.zeros(len(label), bool)
    first[np.cumsum(sizes) - sizes] = True
    told = np.zeros((2, 2))
    for c in (0, 1):
        told[c, c] = weight[~first & (label == c)].sum()

    def grad(theta: np.ndarray) -> np.ndarray:
        p, *rest = chains.marginals(x @ theta[:k], theta[k:].reshape(2, 2))
        g = x.T @ (weight * (p - label)) + penalty * theta[:k]
        return np.concatenate([g, (chains.pairs(*rest, weight) - told + penalty * theta[k:].reshape(2, 2)).ravel()])

    theta = _adam(grad, np.zeros(k + 4), steps, 0.2)
    return theta[:k], theta[k:].reshape(2, 2)


def document_share(p: np.ndarray, size: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the marginals by document (nan: no line)."""
    total = np.bincount(row, weights=size, minlength=n)
    with np.errstate(invalid="ignore"):
        return np.bincount(row, weights=size * p, minlength=n) / total


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, bound: int = BOUND,
        id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Field, calibration curve and share of good documents."""
    sample = training_rows(docs, labels, "quality", modulus, held, bound, id_col, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_buffers(b.column(1))
            for lo, hi in row_chunks(offsets, CHUNK):
                x, size, row = line_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo),
                    pa.array([x[a:z].astype("<f4").tobytes() for a, z in zip(cut, cut[1:])], pa.binary()),
                    pa.array([size[a:z].astype("<f4").tobytes() for a, z in zip(cut, cut[1:])], pa.binary())], names=["y", "x", "size"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, xs, sizes = [], [], []
        for b in batches:
            ys += b.column(0).to_pylist()
            xs += [np.frombuffer(v.as_py(), "<f4").reshape(-1, 3 * OWN) for v in b.column(1)]
            sizes += [np.frombuffer(v.as_py(), "<f4") for v in b.column(2)]
        share = (sum(ys) + 1) / (len(ys) + 1)
        full = [i for i, v in enumerate(sizes) if len(v)]
        y = np.array([ys[i] for i in full], float)
        if not 0 < y.sum() < len(y):
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([share])], names=["model", "share"])
            return
        x, size = np.concatenate([xs[i] for i in full]).astype(float), np.concatenate([sizes[i] for i in full]).astype(float)
        n = np.array([len(sizes[i]) for i in full])
        w, step = fit_field(x, n, y)
        p = Chains(n).marginals(x @ w, step)[0]
        q = document_share(p, size, np.repeat(np.arange(len(n)), n), len(n))

        def curve(ab: np.ndarray) -> np.ndarray:
            e = 1 / (1 + np.exp(-(ab[0] * (q - 0.5) + ab[1]))) - y
            return np.array([(e * (q - 0.5)).mean() + 1e-4 * ab[0], e.mean()])

        ab = _adam(curve, np.zeros(2), 400, 0.1)
        blob = np.concatenate([w, step.ravel(), ab]).astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([share])], names=["model", "share"])

    # The sample has at most ``bound`` rows, so one task can fit the model.
    best = (sample.select("y", "text").mapInArrow(features, "y int, x binary, size binary").coalesce(1)
            .mapInArrow(train, "model binary, share double").first())
    drop(sample)
    if best is None or not best["model"]:
        return {"share": best["share"] if best else 1.0}
    v = np.frombuffer(best["model"], "<f8")
    k = 3 * OWN
    return {"w": v[:k], "step": v[k:k + 4].reshape(2, 2), "curve": v[k + 4:], "share": best["share"]}


def score_chunk(model: dict, data: np.ndarray, offsets: np.ndarray):
    """Score, number of lines and number of bad lines of each row."""
    n = len(offsets) - 1
    x, size, row = line_features(data, offsets)
    lines = np.bincount(row, minlength=n)
    if "w" not in model:
        return np.full(n, float(model["share"])), lines, np.zeros(n, np.int64)
    p = Chains(lines[lines > 0]).marginals(x @ model["w"], model["step"])[0]
    q = document_share(p, size, row, n)
    a, b = model["curve"]
    s = 1 / (1 + np.exp(-np.clip(a * (q - 0.5) + b, -50, 50)))
    return np.where(lines > 0, s, model["share"]), lines, np.bincount(row, weights=p < 0.5, minlength=n).astype(np.int64)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, score, n_lines and n_bad_lines of every row, and its ``row_col``."""
    rows = texts(docs, id_col, text_col, row_col)
    kept = [f for f in rows.schema if f.name != "text"]
    rows = rows.select("text", *(f.name for f in kept))
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("n_lines", LongType()),
                         StructField("n_bad_lines", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_buffers(b.column(0))
            for lo, hi in row_chunks(offsets, CHUNK):
                s, lines, bad = score_chunk(model, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[1:]), pa.array(s), pa.array(lines, pa.int64()),
                                                  pa.array(bad, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = THRESHOLD,
            bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_lines,
    n_bad_lines, and with ``row_col`` that column as row."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, modulus, held, bound, id_col, text_col)
    return score(docs, model, id_col, text_col, row_col).select(
        *(["row"] if row_col else []), "doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
