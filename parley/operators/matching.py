"""Document matching (JN-4..7, AG-8, ST-2, ST-3, AG-11).

Two rankers, both exact and both pruned by upper bounds on matched characters.
Every float step after the bound (x100, in-order sums, the mean, rounding) is
monotonic, so a bound computed with the same operations is never below the
real score. Neither ranker writes pairs of its two sides:

* topics against document heads: meetings with the same topics are one list.
  Lists go to the tasks in blocks, and each task walks its documents, shortest
  first. A document is scored against a list only if the letters they share
  could bring it among the list's best so far; a task returns ``k`` rows a list;
* transcripts against file names: per group of transcripts that hold the same
  catalog characters, names stream by in the order of their bound, and each
  transcript stops listening when no later name can reach its ``k`` best.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.similarity import name_ratio, name_score, ratio, sequence_ratio
from parley.functions.text import clean_text, head_chars, summarize
from parley.operators.ordering import positioned
from parley.session import dealt, stored

# Characters of a document compared with topics, and documents
# kept per meeting.
HEAD_CHARS = 2000
TOP_K = 2
# Documents per topic list that give the first thresholds; topic lists sent to the
# tasks at once; documents bounded together; transcripts that names stream past together.
PROBE = 4
LISTS = 4096
DOCUMENTS = 512
GROUP = 256


def prepare_documents(corpus: DataFrame, head: int = HEAD_CHARS) -> DataFrame:
    """Corpus ``(name, ordinal, text)`` -> adds ``doc_l`` (first ``head``
    characters, cleaned, lower-cased) and its length ``L``.
    Truncation and cleaning run in the JVM before anything is shuffled."""
    return (corpus.withColumn("doc_l", F.lower(clean_text(head_chars("text", head))))
            .withColumn("L", F.length("doc_l")))


def numbered(corpus: DataFrame) -> DataFrame:
    """A corpus whose ``ordinal`` names each document and gives the tie order:
    its own column, or ``(sector, name)`` where it has none (a built corpus)."""
    return corpus if "ordinal" in corpus.columns else corpus.withColumn("ordinal", F.struct("sector", "name"))


def _score_pairs(pairs: DataFrame, meet: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Exact mean topic score for ``pairs (key, ordinal)``.

    Distinct (topic, document) pairs are scored once; the per-topic ratios
    are then folded in topic order, as the reference sums them."""
    per_topic = (pairs.join(meet.select(key, F.explode("ts").alias("t")), key)
                 .select(key, "ordinal", F.col("t.pos").alias("pos"), F.col("t.tl").alias("tl")))
    uniq = per_topic.select("tl", "ordinal").distinct()
    scored = (uniq.join(docs.select("ordinal", "doc_l"), "ordinal")
              .sortWithinPartitions("ordinal")
              .withColumn("r", sequence_ratio(F.col("tl"), F.col("doc_l")))
              .select("tl", "ordinal", "r"))
    j = per_topic.join(scored, ["tl", "ordinal"])
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "r"))), F.lit(0.0),
                         lambda acc, x: acc + x["r"] * F.lit(100.0))
    return (j.groupBy(key, "ordinal")
            .agg((folded / F.count(F.lit(1))).alias("score")))


def _rank(df: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("ordinal").asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topic_lists(topics: DataFrame, key: str) -> DataFrame:
    """``(key, ts)``: each meeting's lower-cased topics in order."""
    return (topics.filter(F.col("topic").isNotNull())
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), F.lower("topic").alias("tl")))).alias("ts"))
            .select(key, F.transform("ts", lambda t: t["tl"]).alias("ts")))


def _order(ordinal) -> tuple:
    """Sorts ordinals (numbers, or structs as dicts) as Spark does, nulls first."""
    parts = ordinal.values() if isinstance(ordinal, dict) else (ordinal,)
    return tuple((p is not None, p) if p is not None else (False,) for p in parts)


class _Letters:
    """Counts the letters of an alphabet in texts."""

    def __init__(self, texts: list[str]) -> None:
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *map(_points, texts)]))

    def counts(self, text: str) -> np.ndarray:
        p, size = _points(text), len(self.alphabet)
        if not size:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, p), size - 1)
        return np.bincount(at[self.alphabet[at] == p], minlength=size)


class _Lists(_Letters):
    """A block of topic lists and each list's best documents so far."""

    def __init__(self, lists: list[list[str]], k: int, start: dict[int, tuple[float, tuple]]) -> None:
        self.k, self.start = k, start
        self.topics = sorted({t for ts in lists for t in ts})
        number = {t: i for i, t in enumerate(self.topics)}
        self.lists = [[number[t] for t in ts] for ts in lists]
        self.size = np.array([len(ts) for ts in lists])
        self.at = np.zeros((len(lists), max(self.size)), np.int64)
        for i, ts in enumerate(self.lists):
            self.at[i, :len(ts)] = ts
        self.length = np.array([len(t) for t in self.topics], np.int64)
        super().__init__(self.topics)
        self.letters = np.stack([self.counts(t) for t in self.topics])
        self.best: list[list[tuple]] = [[] for _ in lists]
        self.least = np.array([start[i][0] if i in start else -1.0 for i in range(len(lists))])

    def mean(self, which: np.ndarray, shared: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lists x documents: the mean of 100 x ratio if ``shared`` (topics x
        documents) characters of each topic matched."""
        total = self.length[:, None] + lengths
        pair = np.where(total == 0, 1.0, 2.0 * shared / np.maximum(total, 1)) * 100.0
        out = np.zeros((len(which), len(lengths)))
        for j in range(self.at.shape[1]):
            has = self.size[which] > j
            out[has] += pair[self.at[which[has], j]]
        return out / self.size[which][:, None]

    def reachable(self, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, documents and bounds (lists x documents) that can still reach
        a list's best: by length, and then by the letters both sides hold."""
        every = np.arange(len(self.lists))
        sizes, back = np.unique(lengths, return_inverse=True)
        open_ = self.mean(every, np.minimum(self.length[:, None], sizes), sizes) >= self.least[:, None]
        which = np.flatnonzero(open_.any(axis=1))
        docs = np.flatnonzero(open_.any(axis=0)[back])
        if not len(which) or not len(docs):
            return which[:0], docs[:0], np.zeros((0, 0))
        held = np.stack([self.counts(texts[d]) for d in docs])
        shared = np.zeros((len(self.topics), len(docs)), np.float32)
        for n in range(1, int(self.letters.max(initial=0)) + 1):
            shared += (self.letters >= n).astype(np.float32) @ (held >= n).astype(np.float32).T
        return which, docs, self.mean(which, shared.astype(np.float64), lengths[docs])

    def promise(self, texts: list[str], ordinals: list, lengths: np.ndarray, n: int) -> None:
        """Take a batch of documents, keeping each list's ``n`` best bounds."""
        which, docs, bounds = self.reachable(texts, lengths)
        for i, bound in zip(which.tolist(), bounds):
            use = np.flatnonzero(bound > self.least[i])
            if len(use):
                use = use[np.argsort(-bound[use], kind="stable")[:n]]
                self.best[i] = sorted([*self.best[i], *((-bound[d], _order(ordinals[docs[d]]), ordinals[docs[d]]) for d in use.tolist())],
                                      key=lambda x: x[:2])[:n]
                if len(self.best[i]) == n:
                    self.least[i] = -self.best[i][-1][0]

    def score(self, i: int, text: str) -> float:
        total = 0.0
        for t in self.lists[i]:
            total += ratio(self.topics[t], text) * 100.0
        return total / len(self.lists[i])

    def _last(self, i: int) -> tuple | None:
        """What a document must not stand behind: (-score, order)."""
        own = [(x[0], x[1]) for x in self.best[i][self.k - 1:]]
        return min(own + [(-self.start[i][0], self.start[i][1])] if i in self.start else own, default=None)

    def offer(self, texts: list[str], ordinals: list, lengths: np.ndarray) -> int:
        """Take a batch of documents; returns the number of ratios computed."""
        which, docs, bounds = self.reachable(texts, lengths)
        order, known = [_order(ordinals[d]) for d in docs], {}
        place = np.empty(len(docs), np.int64)
        place[sorted(range(len(docs)), key=order.__getitem__)] = np.arange(len(docs))
        for i, bound in zip(which.tolist(), bounds):
            best, use, last = self.best[i], np.flatnonzero(bound >= self.least[i]), self._last(i)
            for d in use[np.lexsort((place[use], -bound[use]))].tolist():
                if last and (-bound[d], order[d]) > last:
                    break  # the later ones have smaller bounds or stand behind
                score = 0.0
                for t in self.lists[i]:
                    r = known.get((t, d))
                    if r is None:
                        r = known[t, d] = ratio(self.topics[t], texts[docs[d]])
                    score += r * 100.0
                insort(best, (-(score / len(self.lists[i])), order[d], ordinals[docs[d]]), key=lambda x: x[:2])
                del best[self.k:]
                last = self._last(i)
            if len(best) == self.k:
                self.least[i] = max(self.least[i], -best[-1][0])
        return len(known)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _in_tasks(docs: DataFrame, lists: list[list[str]], k: int, start: dict, take) -> DataFrame:
    """``(place, ordinal, score)`` of each task's best documents; ``take(block,
    texts, ordinals, lengths)`` handles a batch."""
    kind = docs.schema["ordinal"].dataType
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("ordinal", kind), T.StructField("score", T.DoubleType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, arrow = None, None
        for b in batches:
            if block is None:
                block, arrow = _Lists(lists, k, start), b.column(0).type
            for lo in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(lo, DOCUMENTS)
                take(block, part.column(1).to_pylist(), part.column(0).to_pylist(), part.column(2).to_numpy())
        if block is not None:
            rows = [(i, x[2], -x[0]) for i, best in enumerate(block.best) for x in best]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], arrow),
                pa.array([r[2] for r in rows], pa.float64())], names=["place", "ordinal", "score"])

    return docs.select("ordinal", "doc_l", "L").mapInArrow(find, schema)


def best_documents(docs: DataFrame, lists: list[list[str]], k: int, start: dict[int, tuple[float, tuple]],
                   scored: Accumulator | None = None) -> DataFrame:
    """``(place, ordinal, score)``: the ``k`` best of each task's documents for
    each list, the list's place being its number in ``lists``. ``start`` holds
    scores (and orders) that ``k`` documents are known to reach; ``scored``
    counts the ratios computed."""
    def take(block: _Lists, *batch) -> None:
        n = block.offer(*batch)
        if scored is not None:
            scored.add(n)

    return _in_tasks(docs, lists, k, start, take)


def first_scores(docs: DataFrame, lists: list[list[str]], n: int, k: int, scored: Accumulator | None = None) -> DataFrame:
    """``(place, ordinal, score)`` of the ``n`` documents of each list that
    promise most by their letters."""
    n = max(n, k)
    promised = _in_tasks(docs, lists, n, {}, lambda block, *batch: block.promise(*batch, n))
    w = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("ordinal").asc())
    # At most ``n`` rows a list: no more than lists x n are broadcast.
    few = promised.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= n).select("place", "ordinal")
    pairs = docs.join(F.broadcast(few), "ordinal").select("place", "ordinal", "doc_l")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Lists(lists, k, {})
        for b in batches:
            values = [block.score(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            if scored is not None:
                scored.add(sum(len(block.lists[i]) for i in b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.float64())], names=["place", "ordinal", "score"])

    return pairs.mapInArrow(score, promised.schema)


def _lengths_in_reach(lists: list[list[str]], start: dict[int, tuple[float, tuple]], max_len: int) -> tuple[int, int]:
    """Head lengths that can reach some list's known score ``x``: the bound
    grows up to the shortest topic length and falls beyond the longest, so they
    lie in ``[x*min_l/(200-x), max_l*(200/x-1)]`` (widened by one)."""
    low, high = max_len, 0
    for i, ts in enumerate(lists):
        x = start[i][0] if i in start else 0.0
        short, long = min(map(len, ts)), max(map(len, ts))
        low = min(low, int(x * short / (200.0 - x)) - 1)
        high = max(high, max_len if x <= 0 else min(max_len, int(long * (200.0 / x - 1)) + 2))
    return max(low, 0), high


def match_documents(topics: DataFrame, corpus: DataFrame, key: str = "meeting_id", k: int = TOP_K, probe: int = PROBE,
                    lists: int = LISTS, scored: Accumulator | None = None) -> DataFrame:
    """JN-6 + AG-8 + ST-3: top ``k`` documents per meeting by the mean over
    its topics of ``100 * ratio(topic, head)``.

    ``topics``: ``(key, pos, topic)``; ``corpus``: ``(name, ordinal, text)``.
    Returns ``(key, rank, name, ordinal, score)``. Ties keep corpus order
    (``ordinal``), as the reference's stable sort does. A meeting without
    topics gets no rows (the reference divides by zero). As in the
    reference, the ratio favours short documents.

    Meetings with the same topics are matched once. The distinct lists, in
    blocks of ``lists`` of similar length (the bound of what is sent to the
    tasks), are compared with the heads where these lie: one pass finds the
    ``probe`` documents of each list whose letters promise most, their scores
    are the first thresholds, and a pass over the heads of the lengths that can
    reach them finds each task's best."""
    spark = topics.sparkSession
    corpus = numbered(corpus)
    docs = stored(prepare_documents(dealt(corpus.select("ordinal", "text"))).select("ordinal", "doc_l", "L")
                  .sortWithinPartitions("L"), "heads")
    meet = stored(topic_lists(topics, key), "topic-lists")
    max_len = docs.select(F.max("L")).first()[0]
    ordinal = corpus.schema["ordinal"].dataType.simpleString()
    found = spark.createDataFrame([], f"ts array<string>, ordinal {ordinal}, score double, rank int")
    lens = F.transform("ts", lambda t: F.length(t))
    distinct = positioned(meet.select("ts").distinct().select("ts", F.array_max(lens).alias("long"), F.array_min(lens).alias("short")),
                          [("long", True), ("short", True), ("ts", True)])
    top = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("ordinal").asc())

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)

    n_lists = 0 if max_len is None else distinct.count()
    for lo in range(0, n_lists, lists):
        block = [r.ts for r in distinct.filter(F.col("position").between(lo + 1, lo + lists)).orderBy("position").collect()]
        start = {r.place: (r.score, _order(_plain(r.ordinal)))
                 for r in ranked(first_scores(docs, block, probe, k, scored)).filter(F.col("rank") == k).collect()}
        low, high = _lengths_in_reach(block, start, max_len)
        best = ranked(best_documents(docs.filter(F.col("L").between(low, high)), block, k, start, scored))
        named = distinct.select("ts", (F.col("position") - (lo + 1)).alias("place"))
        found = found.unionByName(stored(best.join(named, "place").select("ts", "ordinal", "score", "rank"), "matches"))
    return (meet.join(found, "ts").join(corpus.select("ordinal", "name"), "ordinal")
            .select(key, F.col("rank").cast("int").alias("rank"), "name", "ordinal", "score"))


def _plain(ordinal):
    return ordinal.asDict() if hasattr(ordinal, "asDict") else ordinal


def match_documents_bruteforce(topics: DataFrame, corpus: DataFrame, key: str = "meeting_id",
                               k: int = TOP_K) -> DataFrame:
    """Unpruned reference computation of :func:`match_documents`, for tests
    on small fixtures only (scores every meeting against every document)."""
    corpus = numbered(corpus)
    docs = prepare_documents(corpus.select("name", "ordinal", "text"))
    meet = (topics.withColumn("tl", F.lower(F.col("topic"))).groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), "tl")))
                 .alias("ts")))
    pairs = meet.select(key).join(docs.select("ordinal"), how="cross")
    best = _rank(_score_pairs(pairs, meet, docs, key), key, k)
    return (best.join(corpus.select("ordinal", "name"), "ordinal")
            .select(key, F.col("rank").cast("int").alias("rank"), "name", "ordinal", "score"))


def matched_summaries(matches: DataFrame, corpus: DataFrame) -> DataFrame:
    """JN-7 + SC-4: the chosen documents' texts joined back (after top-k, so
    only k rows per meeting move) and summarised to 40 words."""
    return (matches.join(numbered(corpus).select("ordinal", "text"), "ordinal")
            .withColumn("summary", summarize("text")).drop("text"))


def document_block(summaries: DataFrame, key: str = "meeting_id") -> DataFrame:
    """AG-11: ``name: summary`` lines joined by newlines in rank order."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(": ", "name", "summary").alias("line"))))
    return summaries.groupBy(key).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("document_block"))


# --- rule path: transcript vs file name (JN-3..5, ST-2) ------------------------

def candidate_documents(sectors: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """JN-4: detected sector -> its documents (equi-join on sector; a sector
    with no folder yields nothing)."""
    return sectors.join(catalog.select("sector", "name"), "sector")


def _code_points(c: Column) -> Column:
    # One element per code point (a surrogate pair stays whole).
    return F.regexp_extract_all(c, F.lit("(?s)."), 0)


# A character that stands for "absent from the transcript" in masked names.
_ABSENT = "\u0000"


def _present_in(present: Column, c: Column) -> Column:
    # ``present`` is a string of distinct code points, so a substring hit on
    # one code point is a set-membership test.
    return F.instr(present, c) > 0


class _Listener:
    """A transcript and the best names that have streamed past it."""

    def __init__(self, key, text: str, k: int) -> None:
        self.key, self.text, self.k = key, text, k
        self.best: list[tuple[int, str]] = []
        self.known: dict[str, int] = {}

    def offer(self, names: list[str], probes: list[str], sizes: np.ndarray, letters: _Letters, held: np.ndarray, by_name: np.ndarray) -> int:
        """Take a chunk of names; returns the number of ratios computed."""
        la, before = len(self.text), len(self.known)
        m = np.minimum(held, letters.counts(self.text)).sum(axis=1)
        bound = np.rint(100.0 * (2.0 * m / np.maximum(la + sizes, 1))).astype(np.int64)
        use = np.arange(len(names)) if len(self.best) < self.k else np.flatnonzero(bound >= -self.best[-1][0])
        for i in use[np.lexsort((by_name[use], -bound[use]))].tolist():
            if len(self.best) == self.k and (-int(bound[i]), names[i]) > self.best[-1]:
                break
            score = self.known.get(probes[i])
            if score is None:
                score = self.known[probes[i]] = name_score(self.text, probes[i]) if sizes[i] else 0
            insort(self.best, (-score, names[i]))
            del self.best[self.k:]
        return len(self.known) - before


def _stream_names(rows: DataFrame, key: str, k: int, scored: Accumulator | None) -> DataFrame:
    """``rows`` sorted by group, transcripts (tag 0) before names (tag 1):
    ``(key, sector, name, score)``, the ``k`` best of each transcript and sector."""
    schema = T.StructType([rows.schema[key], T.StructField("sector", T.StringType()), T.StructField("name", T.StringType()),
                           T.StructField("score", T.IntegerType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, listeners, kind = None, [], None

        def results():
            out = [(x.key, group[1], name, -score) for x in listeners for score, name in x.best]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string()),
                pa.array([r[3] for r in out], pa.int32())], names=[key, "sector", "name", "score"])

        for b in batches:
            kind = b.schema.field(key).type
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            at = list(zip(col["sig"].to_pylist(), col["sector"].to_pylist(), col["salt"].to_pylist(), col["tag"].to_pylist()))
            lo = 0
            while lo < len(at):
                hi = next((i for i in range(lo + 1, len(at)) if at[i] != at[lo]), len(at))
                if at[lo][:3] != group:
                    if listeners:
                        yield results()
                    group, listeners = at[lo][:3], []
                part = {n: c.slice(lo, hi - lo) for n, c in col.items()}
                if at[lo][3] == 0:
                    listeners += [_Listener(x, t, k) for x, t in zip(part[key].to_pylist(), part["tl"].to_pylist())]
                else:
                    names = part["name"].to_pylist()
                    by_name = np.empty(len(names), np.int64)
                    by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                    probes = part["probe"].to_pylist()
                    letters = _Letters([p.replace(_ABSENT, "") if group[0] != _ABSENT else p for p in probes])
                    held = np.stack([letters.counts(p) for p in probes])
                    for x in listeners:
                        n = x.offer(names, probes, part["lb"].to_numpy().astype(np.int64), letters, held, by_name)
                        if scored is not None:
                            scored.add(n)
                lo = hi
        if listeners:
            yield results()

    return rows.mapInArrow(find, schema)


def rank_by_name(transcripts: DataFrame, sectors: DataFrame, catalog: DataFrame, key: str = "conv_id", k: int = TOP_K,
                 group: int = GROUP, scored: Accumulator | None = None) -> DataFrame:
    """JN-4 + JN-5 + ST-2: per transcript, the top ``k`` catalog files of its
    detected sectors by ``name_ratio(lower(text), lower(name))``.

    ``transcripts``: ``(key, text)``; ``sectors``: ``(key, sector)``;
    ``catalog``: ``(sector, name)``. Ties (frequent: scores are whole
    numbers) are broken by name, then sector; the reference's order there
    follows set iteration and is not reproducible. Returns
    ``(key, rank, sector, name, score)``.

    Exact, and no table of transcripts x names is made:

    * a name character the transcript lacks can never be matched, so it is
      replaced by one placeholder without changing the ratio. What a
      transcript contributes is its *signature*: which characters of the
      catalog's alphabet it holds. Masked names are computed per
      (signature, sector, name), and signatures repeat across transcripts;
    * names with the same masked form (numbering, dates) score the same
      against a transcript, so only the ``k`` smallest of each group can
      reach the top ``k`` (a partial ``WindowGroupLimit``);
    * the names of a (signature, sector) are one list, those with the most
      characters that can match first. It streams past the transcripts of
      that signature, ``group`` of them at a time (a hot signature is dealt
      over several copies of the list). A transcript asks the matcher only for
      names whose letters (as often as the transcript holds them) could reach
      its ``k`` best so far, and once per masked form; a task holds the texts
      of one group."""
    # Lower-cased transcripts feed every later step.
    t = stored(transcripts.select(key, F.lower(F.col("text")).alias("tl")), "lowered")
    cat = (catalog.select("sector", "name").distinct()
           .withColumn("nl", F.lower(F.col("name"))).withColumn("lb", F.length("nl")))
    alphabet = cat.select(F.explode(_code_points(F.col("nl"))).alias("ch")).distinct()
    # Distinct characters per transcript as a per-row expression first, so
    # only a few dozen rows per transcript reach the shuffle.
    present = (t.select(key, F.explode(F.array_distinct(_code_points(F.col("tl")))).alias("ch"))
               .join(alphabet, "ch", "left_semi")
               .groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("sig")))
    # A transcript holding the placeholder itself is never masked: its
    # signature is the placeholder alone, which no other signature holds.
    signed = (t.select(key, (F.instr(F.col("tl"), F.lit(_ABSENT)) > 0).alias("nul")).join(present, key, "left")
              .select(key, F.when(F.col("nul"), F.lit(_ABSENT)).otherwise(F.coalesce("sig", F.lit(""))).alias("sig")))
    ts = stored(signed.join(sectors.select(key, "sector").distinct(), key), "signatures")
    salts = ts.groupBy("sig", "sector").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("salts"))

    # Masked names per (signature, sector): only signatures that occur with
    # that sector, so the work grows with distinct signatures, not pairs.
    unmasked = F.col("sig") == F.lit(_ABSENT)
    kept_mask = F.transform(_code_points(F.col("nl")),
                            lambda c: F.when(unmasked | _present_in(F.col("sig"), c), c).otherwise(F.lit(_ABSENT)))
    named = (salts.join(cat, "sector")
             .withColumn("probe", F.array_join(kept_mask, ""))
             .withColumn("kept", F.when(unmasked, F.col("lb")).otherwise(F.size(F.filter(kept_mask, lambda c: c != F.lit(_ABSENT))))))
    wg = Window.partitionBy("sig", "sector", "probe").orderBy("name")
    names = (named.withColumn("i", F.row_number().over(wg)).filter(F.col("i") <= k)
             .select("sig", "sector", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("tag"),
                     "name", "probe", "lb", "kept"))
    dealt_out = (ts.join(salts, ["sig", "sector"])
                 .select(key, "sig", "sector", F.pmod(F.xxhash64(key), "salts").cast("int").alias("salt"), F.lit(0).alias("tag"))
                 .join(t, key))
    n = int(transcripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (dealt_out.unionByName(names, allowMissingColumns=True)
            .repartition(n, "sig", "sector", "salt")
            .sortWithinPartitions("sig", "sector", "salt", "tag", F.col("kept").desc(), "lb", "name"))
    wr = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("name").asc(), F.col("sector").asc())
    best = (_stream_names(rows, key, k, scored)
            .withColumn("rank", F.row_number().over(wr)).filter(F.col("rank") <= k))
    return best.select(key, F.col("rank").cast("int").alias("rank"), "sector", "name", "score")


def rank_by_name_bruteforce(transcripts: DataFrame, sectors: DataFrame, catalog: DataFrame,
                            key: str = "conv_id", k: int = TOP_K) -> DataFrame:
    """Unpruned :func:`rank_by_name`, for tests on small fixtures only."""
    pairs = candidate_documents(sectors, catalog, key).join(transcripts.select(key, "text"), key)
    s = pairs.select(key, "sector", "name",
                     name_ratio(F.lower(F.col("text")), F.lower(F.col("name"))).alias("score"))
    wr = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("name").asc(), F.col("sector").asc())
    return (s.withColumn("rank", F.row_number().over(wr)).filter(F.col("rank") <= k)
            .select(key, F.col("rank").cast("int").alias("rank"), "sector", "name", "score"))
