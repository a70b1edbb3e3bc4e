"""Operator 10, licence scans with a generalised suffix automaton.

The automaton holds the word sequences of all licence templates. A document's
words are streamed through it: the state and the matched length after each
word are the matching statistics. Matches of ``min_match`` words or more that
cannot grow are kept and chained, in document order, into spans of a template:
a match joins a chain if it lies later in the template and starts at most
``max_gap`` words after it. A span that covers ``min_cover`` of a template adds
its label; the score is the largest cover. The Creative Commons attribution
notices differ by one or two words only, so a span of such a template counts
only if the elements (attribution, non-commercial, share-alike, no derivatives)
stated in it, in its gaps and in the place of the template's missing end are
exactly those of the label. Beside that, all places of the base phrases are
counted.

A word outside the templates' vocabulary resets the statistics, so words are
first mapped to template words by vectorised hashing and only runs of known
words are streamed. The templates are constants, so the automaton is small and
is built once per Python worker. The job is one pass without a shuffle.

Defined results: null text is empty; no word gives n_words 0, no places, null
first_word and last_word, empty label strings and score 0; repeated rows and
null ids each get their row; an empty table gives an empty result; other
columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from parley.llm import tokens as tk
from parley.llm.common import prepare, row_chunks, string_buffers, texts
from parley.llm.licence_texts import ELEMENTS, PHRASES, TEMPLATES

MIN_MATCH = 4
MAX_GAP = 12
MIN_COVER = 0.6
CHUNK = 4 << 20


def split_words(text: str) -> list[bytes]:
    data = tk.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = tk.spans(data, np.array([0, len(data)]), tk.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s, e)]


class SuffixAutomaton:
    """Of several token sequences: each state is a class of substrings with
    the same end places."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, seq in enumerate(sequences):
            last = 0
            for pos, symbol in enumerate(seq):
                last = self._extend(last, symbol)
                self.ends[last].add((which, pos + 1))
        # End places of a state include those of the states that link to it.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.places = [sorted(x) for x in self.ends]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, q: int, symbol: int) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # already a prefix of an earlier sequence's part
            q = self.next[last][symbol]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
        cur, p = self._state(self.length[last] + 1), last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][symbol]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return cur

    def statistics(self, symbols) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each symbol."""
        state = matched = 0
        for x in symbols:
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                matched += 1
            yield state, matched

    def long_matches(self, symbols, least: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of matches that cannot grow to the right."""
        before = None
        for i, (state, matched) in enumerate(self.statistics(symbols)):
            if before and matched != before[1] + 1 and before[1] >= least:
                yield i - before[1], i, before[0]
            before = (state, matched)
        if before and before[1] >= least:
            yield len(symbols) - before[1], len(symbols), before[0]


class Licences:
    """The automaton with its vocabulary and the base phrases."""

    def __init__(self, templates=tuple(TEMPLATES), phrases=tuple(PHRASES), elements=tuple(ELEMENTS)) -> None:
        self.labels = [label for label, _ in templates]
        seqs = [split_words(t) for _, t in templates]
        vocab = sorted({w for s in seqs for w in s}, key=tk.hash_word)
        number = {w: i for i, w in enumerate(vocab)}
        self.hashes = np.array([tk.hash_word(w) for w in vocab], np.uint64)
        self.sizes = [len(s) for s in seqs]
        self.automaton = SuffixAutomaton([[number[w] for w in s] for s in seqs])
        self.phrases = [(np.array([tk.hash_word(w) for w in split_words(p)], np.uint64), label) for p, label in phrases]
        self.needed = [set(label.split("-")[1:]) if label.startswith("cc-by") else None for label in self.labels]
        self.elements: dict[int, list[tuple[list[int], str]]] = {}  # by first word
        for p, element in elements:
            words = [int(tk.hash_word(w)) for w in split_words(p)]
            self.elements.setdefault(words[0], []).append((words, element))

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def stated(self, words: np.ndarray) -> set[str]:
        """Licence elements that a run of word hashes states."""
        h = words.tolist()
        return {element for i, w in enumerate(h) for phrase, element in self.elements.get(w, ())
                if h[i:i + len(phrase)] == phrase}

    def chains(self, matches, max_gap: int, words: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word, last word + 1, covered words) of each chain;
        matches come in document order. With the document's word hashes, chains
        that state other licence elements than their label are left out."""
        for which, (first, end, stop, covered) in self._runs(matches, max_gap):
            needed = self.needed[which] if words is not None else None
            if needed is None or self.stated(words[first:end + self.sizes[which] - stop]) == needed:
                yield which, first, end, covered

    def _runs(self, matches, max_gap: int) -> Iterator[tuple[int, list[int]]]:
        run: dict[int, list[int]] = {}  # template: [first, end, template end, covered]
        for start, end, state in matches:
            size = end - start
            options: dict[int, list[int]] = {}
            for which, stop in self.automaton.places[state]:
                options.setdefault(which, []).append(stop)
            for which, stops in options.items():
                now = run.get(which)
                later = [s for s in stops if now and start - now[1] <= max_gap and s - size >= now[2]]
                if now and later:
                    now[3] += size - max(0, now[1] - start)
                    now[1], now[2] = end, later[0]
                else:
                    if now:
                        yield which, now
                    run[which] = [start, end, stops[0], size]
        yield from run.items()


@lru_cache(maxsize=1)
def _licences() -> Licences:
    return Licences()


def scan_chunk(model: Licences, data: np.ndarray, offsets: np.ndarray, min_match: int, max_gap: int, min_cover: float):
    """Per row of the chunk: n_words, n_base, first and last place (-1: none),
    base labels, all labels, score and the covered template spans."""
    n = len(offsets) - 1
    low = tk.LOWER[data]
    s, e, row = tk.spans(low, offsets, tk.ALNUM)
    h = tk.hashes(low, s, e)
    first_of_row = np.searchsorted(row, np.arange(n))
    n_words = np.bincount(row, minlength=n)
    n_base = np.zeros(n, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base: list[set[str]] = [set() for _ in range(n)]
    for words, label in model.phrases:
        k = len(words)
        if len(h) < k:
            continue
        hit = row[:len(row) - k + 1] == row[k - 1:]
        for j, w in enumerate(words):
            hit &= h[j:len(h) - k + 1 + j] == w
        at = np.flatnonzero(hit)
        r = row[at]
        place = at - first_of_row[r]
        np.add.at(n_base, r, 1)
        np.minimum.at(first, r, place)
        np.maximum.at(last, r, place)
        for x in np.unique(r):
            base[x].add(label)
    first[n_base == 0] = -1
    # Runs of template words inside one row.
    sym = model.symbols(h)
    known = sym >= 0
    more = {}
    if len(sym):
        new = np.ones(len(sym), bool)
        new[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(sym)))
        for a, m in zip(at[known[at] & (size >= min_match)], size[known[at] & (size >= min_match)]):
            r = int(row[a])
            shift = int(a - first_of_row[r])
            found = [(shift + x, shift + y, st)
                     for x, y, st in model.automaton.long_matches(sym[a:a + m].tolist(), min_match)]
            if found:
                more.setdefault(r, []).extend(found)
    score = np.zeros(n)
    labels = [set(b) for b in base]
    places: list[list[tuple[str, int, int, float]]] = [[] for _ in range(n)]
    for r, matches in more.items():
        best: dict[tuple[str, int, int], float] = {}  # spellings of one notice can share a span
        for which, a, b, covered in model.chains(matches, max_gap, h[first_of_row[r]:first_of_row[r] + n_words[r]]):
            cover = min(1.0, covered / model.sizes[which])
            score[r] = max(score[r], cover)
            if cover >= min_cover:
                labels[r].add(model.labels[which])
                key = model.labels[which], a, b
                best[key] = max(best.get(key, 0.0), cover)
        places[r] = [(*key, cover) for key, cover in best.items()]
    return n_words, n_base, first, last, base, labels, score, places


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH,
                 max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans (label, first word, end word, cover of
    each covered template, as text)."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    long, text = LongType(), StringType()
    schema = StructType([
        StructField("doc_id", rows.schema["doc_id"].dataType), StructField("n_words", long), StructField("n_base", long),
        StructField("first_word", long), StructField("last_word", long), StructField("base_labels", text),
        StructField("labels", text), StructField("score", DoubleType()), StructField("spans", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _licences()
        for b in batches:
            data, offsets = string_buffers(b.column(1))
            for lo, hi in row_chunks(offsets, CHUNK):
                part = data[offsets[lo]:offsets[hi]]
                nw, nb, first, last, base, labels, score, places = scan_chunk(
                    model, part, offsets[lo:hi + 1] - offsets[lo], min_match, max_gap, min_cover)
                none = nb == 0
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(nw, pa.int64()), pa.array(nb, pa.int64()),
                    pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()),
                    pa.array([";".join(f"{w}:{a}-{z}:{c:.3f}" for w, a, z, c in p) for p in places], pa.string()),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)
