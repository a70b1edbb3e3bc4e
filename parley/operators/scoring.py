"""Score analytics over stored meetings (WN-1/2, AG-1..6, AG-10, ST-5,
PRJ-16/17/20/22).

Input is the meetings table (``id, sales_id, meeting_ts, scoring_json``...).
Skew notes: one agent may own a large share of all meetings, so nothing
here sorts an agent's whole history. Only the five newest meetings per
agent get a special weight; they are found with ``row_number() <= 5``,
which Catalyst turns into a partial ``WindowGroupLimit`` before the shuffle.
The weighted mean is "every meeting at the tail weight" (a hash aggregation
with map-side partial sums) plus "the extra weight of the five newest"
(a few rows per agent), so the meetings table is never shuffled row by row
or joined. Both parts merge with those of other meetings (``agent_summary``);
``operators.agent_state`` keeps them per batch of new meetings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.jsonfn import object_entries, object_entry_array
from parley.functions.numeric import exact_mean, score_band, score_units, score_value
from parley.functions.text import display_ts, metric_label
from parley.session import stored

# Recency weights of the newest five meetings, then the tail
# weight; stored x10 as integers so sums are exact.
RECENCY_WEIGHTS_X10 = [10, 8, 6, 4, 2]
TAIL_WEIGHT_X10 = 1

MEETING_KEY = ["sales_id", "id"]


def _recency_order():
    return [F.col("meeting_ts").desc(), F.col("id").desc()]


def scores_long(meetings: DataFrame, extra: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Long scores ``(id, sales_id, meeting_ts, *extra, pos, metric, value,
    units)`` from ``scoring_json``; ``pos`` is the key's position in the JSON
    text, ``units`` the exact value. Entries that are not finite numbers are
    left to :func:`rejected_scores`; with ``strict`` they fail the job, as in
    the reference."""
    keep = ["id", "sales_id", "meeting_ts", *extra]
    e = object_entries(meetings, "scoring_json", keep, key_name="metric", value_name="raw")
    e = e.withColumn("units", score_units(F.col("raw")))
    if strict:
        text = F.concat(F.lit("score is not a number: "), F.coalesce("raw", F.lit("null")))
        e = e.withColumn("units", F.coalesce("units", F.raise_error(text).cast("decimal(27,0)")))
    return (e.filter(F.col("units").isNotNull())
            .select(*keep, F.col("pos").cast("bigint").alias("pos"), "metric",
                    score_value(F.col("raw")).alias("value"), "units"))


def rejected_scores(meetings: DataFrame) -> DataFrame:
    """SC-8: every score entry that is not a finite number in range:
    ``(id, sales_id, pos, metric, raw, reason)``."""
    e = object_entries(meetings, "scoring_json", ["id", "sales_id"], key_name="metric", value_name="raw")
    d = F.trim("raw").try_cast("double")
    reason = (F.when(F.col("raw").isNull(), F.lit("null"))
              .when(d.isNull(), F.lit("not a number"))
              .when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit("not finite"))
              .otherwise(F.lit("out of range")))
    return (e.filter(score_units(F.col("raw")).isNull())
            .select("id", "sales_id", F.col("pos").cast("bigint").alias("pos"), "metric", "raw", reason.alias("reason")))


def recent_meetings(meetings: DataFrame, n: int = 5) -> DataFrame:
    """WN-1 restricted to the head: each agent's ``n`` newest meetings with
    ``recency_rank`` 1..n (ties on time broken by id, newest id first)."""
    w = Window.partitionBy("sales_id").orderBy(*_recency_order())
    return (meetings.withColumn("recency_rank", F.row_number().over(w))
            .filter(F.col("recency_rank") <= n))


def recency_weights(meetings: DataFrame) -> DataFrame:
    """WN-1: every meeting with ``weight_x10`` (10, 8, 6, 4, 2, then 1).

    The join key (sales_id, id) is unique per meeting, so the join has no
    hot key; the small side holds at most five rows per agent."""
    head = recent_meetings(meetings.select(*MEETING_KEY, "meeting_ts"), len(RECENCY_WEIGHTS_X10))
    wexpr = F.element_at(F.array(*[F.lit(w) for w in RECENCY_WEIGHTS_X10]),
                         F.col("recency_rank").cast("int"))
    head = head.select(*MEETING_KEY, "recency_rank", wexpr.alias("head_weight_x10"))
    return (meetings.join(head, MEETING_KEY, "left")
            .withColumn("weight_x10", F.coalesce("head_weight_x10", F.lit(TAIL_WEIGHT_X10)))
            .drop("head_weight_x10"))


_HEAD = "array<struct<meeting_ts:timestamp_ntz,id:string,scores:array<struct<pos:int,metric:string,units:decimal(27,0)>>>>"


def score_rows(meetings: DataFrame) -> DataFrame:
    """``(sales_id, id, meeting_ts, scores)``: each meeting's usable scores, read
    from its JSON text once and written."""
    entries = F.transform(object_entry_array("scoring_json", "metric", "raw"), lambda e: F.struct(
        e["pos"].cast("int").alias("pos"), e["metric"].alias("metric"), score_units(e["raw"]).alias("units")))
    scores = F.coalesce(F.filter(entries, lambda e: e["units"].isNotNull()), F.array())
    return stored(meetings.select("sales_id", "id", "meeting_ts", scores.alias("scores")), "score-rows")


def agent_summary(meetings: DataFrame) -> DataFrame:
    """What the scores of an agent need of a set of meetings, in rows that
    merge with those of any other set (:func:`merged_summary`): per (agent,
    metric) the sum at the tail weight and where the metric was seen first; per
    agent (``metric`` NULL) the total weight, the count, the first and last
    time, and the five newest meetings with their scores.

    The meetings are scanned once. No agent's history is sorted: sums are
    partial aggregates, the newest five a ``WindowGroupLimit``."""
    rows = score_rows(meetings)
    total_row = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("metric"),
                                 F.lit(None).cast("decimal(27,0)").alias("units")))
    is_total = F.col("metric").isNull()
    part = F.when(is_total, F.lit(TAIL_WEIGHT_X10).cast("decimal(30,0)")).otherwise(
        (F.col("units") * F.lit(TAIL_WEIGHT_X10).cast("decimal(2,0)")).cast("decimal(30,0)"))
    sums = (rows.select("sales_id", "id", "meeting_ts", F.inline(F.concat("scores", total_row)))
            .groupBy("sales_id", "metric")
            .agg(F.sum(part).cast("decimal(38,0)").alias("num"),
                 F.max(F.when(~is_total, F.struct("meeting_ts", "id", (-F.col("pos")).alias("neg_pos")))).alias("first_seen"),
                 F.count(F.when(is_total, F.lit(1))).alias("n_meetings"),
                 F.min(F.when(is_total, F.col("meeting_ts"))).alias("first_ts"),
                 F.max(F.when(is_total, F.col("meeting_ts"))).alias("last_ts"))
            .withColumn("head", F.lit(None).cast(_HEAD)))
    newest = recent_meetings(rows, len(RECENCY_WEIGHTS_X10)).groupBy("sales_id").agg(
        F.collect_list(F.struct("meeting_ts", "id", "scores")).cast(_HEAD).alias("head"))
    empty = [F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in ("num", "first_seen", "n_meetings", "first_ts", "last_ts")]
    return sums.unionByName(newest.select("sales_id", F.lit(None).cast("string").alias("metric"), *empty, "head"))


def merged_summary(summary: DataFrame) -> DataFrame:
    """One row per (agent, metric) of the rows of any number of
    :func:`agent_summary` results over different meetings; the newest five of
    all are among the newest five of each."""
    newest = F.slice(F.sort_array(F.flatten(F.collect_list("head")), asc=False), 1, len(RECENCY_WEIGHTS_X10))
    return (summary.groupBy("sales_id", "metric")
            .agg(F.sum("num").cast("decimal(38,0)").alias("num"), F.max("first_seen").alias("first_seen"),
                 F.sum("n_meetings").alias("n_meetings"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
                 newest.alias("head"))
            .withColumn("head", F.when(F.col("metric").isNull(), F.col("head"))))


def weighted_table(summary: DataFrame) -> DataFrame:
    """Per (agent, metric) the weighted sum ``num``, with one per-agent row
    (``metric`` NULL); ``den`` is the agent's total weight. The tail sums get
    the extra weight of the five newest meetings on top."""
    merged = merged_summary(summary)
    extra = F.array(*[F.lit(w - TAIL_WEIGHT_X10) for w in RECENCY_WEIGHTS_X10])
    weighed = F.flatten(F.transform("head", lambda m, i: F.transform(
        F.concat(m["scores"], F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("metric"),
                                               F.lit(1).cast("decimal(27,0)").alias("units")))),
        lambda s: F.struct(s["metric"].alias("metric"),
                           (s["units"] * F.element_at(extra, i + 1).cast("decimal(2,0)")).cast("decimal(38,0)").alias("num")))))
    own = F.array(F.struct("metric", "num"))
    parts = merged.select("sales_id", F.col("metric").alias("of"), "first_seen", "n_meetings", "first_ts", "last_ts",
                          F.inline(F.concat(own, F.coalesce(weighed, F.array().cast("array<struct<metric:string,num:decimal(38,0)>>")))))
    # A row's own facts count once: they belong to the row's own metric.
    mine = F.col("of").eqNullSafe(F.col("metric")) & F.col("first_ts").isNotNull()
    agg = (parts.groupBy("sales_id", "metric")
           .agg(F.sum("num").alias("num"), F.max(F.when(F.col("of").isNotNull(), F.col("first_seen"))).alias("first_seen"),
                F.max(F.when(mine, F.col("n_meetings"))).alias("n_meetings"), F.min(F.when(mine, F.col("first_ts"))).alias("first_ts"),
                F.max(F.when(mine, F.col("last_ts"))).alias("last_ts")))
    # The per-agent total sits in the same small aggregated table; a window
    # by agent attaches it without re-reading the meetings.
    den = F.max(F.when(F.col("metric").isNull(), F.col("num"))).over(Window.partitionBy("sales_id"))
    return agg.withColumn("den", den)


def _agent_metric_table(meetings: DataFrame) -> DataFrame:
    return weighted_table(agent_summary(meetings))


def _scores_from_table(table: DataFrame) -> DataFrame:
    score = exact_mean(F.col("num"), F.col("den"))
    return (table.filter(F.col("metric").isNotNull())
            .select("sales_id", "metric", score.alias("weighted_score"), "first_seen"))


def weighted_scores(meetings: DataFrame) -> DataFrame:
    """AG-3 (+PRJ-16, PRJ-17): recency-weighted mean per (agent, metric).

    Sum of value*weight over the agent's meetings that carry the metric,
    divided by the weight of *all* the agent's meetings (meetings without
    the metric, or without any score, still count), rounded half-up to 2.
    Also returns ``first_seen`` (the newest (ts, id, -pos) at which the
    metric occurs) for tie rules."""
    return _scores_from_table(_agent_metric_table(meetings))


def weighted_score_cards(meetings: DataFrame) -> DataFrame:
    """Weighted scores with their label and band, as shown per agent."""
    return cards_of(_agent_metric_table(meetings))


def cards_of(table: DataFrame) -> DataFrame:
    return _scores_from_table(table).select("sales_id", "metric", metric_label("metric").alias("metric_label"),
                                            "weighted_score", score_band(F.col("weighted_score")).alias("band"))


def best_worst_by_agent(meetings: DataFrame) -> DataFrame:
    """AG-6: per agent, best and worst metric by rounded weighted score.

    Ties go to the metric seen first walking the agent's meetings newest to
    oldest (the insertion order of the reference's dict)."""
    return _best_worst(weighted_scores(meetings))


def _best_worst(ws: DataFrame) -> DataFrame:
    best = F.max(F.struct(F.col("weighted_score"), F.col("first_seen"), F.col("metric")))
    worst = F.max(F.struct((-F.col("weighted_score")).alias("neg"), F.col("first_seen"), F.col("metric")))
    return (ws.groupBy("sales_id")
            .agg(best.alias("b"), worst.alias("w"))
            .select("sales_id",
                    F.col("b.metric").alias("best_metric"), F.col("b.weighted_score").alias("best_score"),
                    F.col("w.metric").alias("worst_metric"), (-F.col("w.neg")).alias("worst_score")))


def meeting_span(meetings: DataFrame) -> DataFrame:
    """AG-1 + AG-2 per agent: meeting count and both ends of the history.

    The reference labels the *oldest* meeting "Last Meeting"; here both ends
    are published under honest names."""
    return (meetings.groupBy("sales_id")
            .agg(F.count(F.lit(1)).alias("meeting_count"),
                 F.min("meeting_ts").alias("first_ts"), F.max("meeting_ts").alias("last_ts"))
            .select("sales_id", "meeting_count",
                    display_ts("first_ts").alias("first_meeting"),
                    display_ts("last_ts").alias("last_meeting")))


def agent_profile(meetings: DataFrame) -> DataFrame:
    """PL-2 header: count, span, best and worst with bands, one row per
    agent. Agents without any score keep NULL best/worst.

    Everything comes from one aggregation per agent over the agent x metric
    table (already partitioned by agent), so the meetings are scanned once
    and no second branch re-reads them."""
    return profile_of(_agent_metric_table(meetings))


def profile_of(table: DataFrame) -> DataFrame:
    """:func:`agent_profile` from the weighted table."""
    is_total = F.col("metric").isNull()
    score = exact_mean(F.col("num"), F.col("den"))
    metric_row = ~is_total
    best = F.max(F.when(metric_row, F.struct(score.alias("s"), F.col("first_seen"), F.col("metric"))))
    worst = F.max(F.when(metric_row, F.struct((-score).alias("neg"), F.col("first_seen"), F.col("metric"))))
    prof = (table.groupBy("sales_id")
            .agg(F.max(F.when(is_total, F.col("n_meetings"))).alias("meeting_count"),
                 F.max(F.when(is_total, F.col("first_ts"))).alias("first_ts"),
                 F.max(F.when(is_total, F.col("last_ts"))).alias("last_ts"),
                 best.alias("b"), worst.alias("w")))
    return prof.select(
        "sales_id", "meeting_count",
        display_ts("first_ts").alias("first_meeting"), display_ts("last_ts").alias("last_meeting"),
        F.col("b.metric").alias("best_metric"), F.col("b.s").alias("best_score"),
        F.col("w.metric").alias("worst_metric"), (-F.col("w.neg")).alias("worst_score"),
        metric_label(F.col("b.metric")).alias("best_label"), metric_label(F.col("w.metric")).alias("worst_label"),
        F.when(F.col("b").isNotNull(), score_band(F.col("b.s"))).alias("best_band"),
        F.when(F.col("w").isNotNull(), score_band(-F.col("w.neg"))).alias("worst_band"))


def latest_scores(meetings: DataFrame, n: int = 5) -> DataFrame:
    """WN-2: the ``n`` newest meetings per agent, scores in long form."""
    head = recent_meetings(meetings.select("id", "sales_id", "meeting_ts", "scoring_json"), n)
    return (scores_long(head, ("recency_rank",))
            .select("sales_id", "id", F.col("recency_rank").cast("bigint").alias("recency_rank"), display_ts("meeting_ts").alias("meeting_date"),
                    "pos", "metric", "value"))


def metric_means(meetings: DataFrame) -> DataFrame:
    """AG-4: mean per metric over all score rows (absent metrics do not
    count, unlike AG-3), rounded half-up to 2."""
    return means_of(scores_long(meetings))


def means_of(scores: DataFrame) -> DataFrame:
    """AG-4 over a long score table."""
    g = scores.groupBy("metric").agg(F.sum("units").alias("num"), F.count(F.lit(1)).alias("n"))
    return g.select("metric", metric_label("metric").alias("metric_label"),
                    exact_mean(F.col("num"), F.col("n")).alias("avg_score"), F.col("n").alias("n_scores"))


# Executive-summary sentences (PRJ-22).
EXEC_SUMMARY_TEMPLATE = (
    "**Overall Performance Snapshot**\n"
    "- The strongest capability across all meetings is **{best}** scoring **{best_score}/10**.\n"
    "- The area needing the most improvement is **{worst}** with an average score of **{worst_score}/10**.\n"
    "\n"
    "**Recommendation**\n"
    "- Focus training and coaching on improving the lowest metric.\n"
    "- Use high-performing metrics as best-practice templates to duplicate across the team.")


def _fmt_score(c):
    # Python prints the float with its shortest repr (7.0, 6.25); Spark's
    # double-to-string cast does the same for scores in 0..10.
    return c.cast("string")


def best_worst_global(meetings: DataFrame) -> DataFrame:
    """AG-5 + AG-1 + PRJ-22: one row with the best and worst metric of the
    per-metric means (ties: alphabetical), the meeting count and the
    executive summary text. No scores at all -> no row.

    One scan: the per-metric sums and the meeting count (a NULL-metric row
    per meeting) come out of the same aggregation; best and worst are a
    final aggregation over that small table."""
    total_row = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("metric"),
                                 F.lit(None).cast("string").alias("raw")))
    entries = F.concat(object_entry_array("scoring_json", "metric", "raw"), total_row)
    is_total = F.col("metric").isNull()
    rows = (meetings.select(F.inline(entries))
            .withColumn("units", score_units(F.col("raw")))
            .filter(is_total | F.col("units").isNotNull()))
    g = rows.groupBy("metric").agg(F.sum("units").alias("num"), F.count(F.lit(1)).alias("n"))
    return best_worst_of(g)


def best_worst_of(g: DataFrame) -> DataFrame:
    """AG-5 over one aggregated row per metric ``(metric, num, n)`` and one
    with a NULL metric that counts the meetings."""
    is_total = F.col("metric").isNull()
    avg = exact_mean(F.col("num"), F.col("n"))
    agg = g.agg(F.min(F.when(~is_total, F.struct((-avg).alias("neg"), F.col("metric")))).alias("b"),
                F.min(F.when(~is_total, F.struct(avg.alias("avg_score"), F.col("metric")))).alias("w"),
                F.max(F.when(is_total, F.col("n"))).alias("total_meetings"))
    out = agg.filter(F.col("b").isNotNull())
    best, worst = F.col("b.metric"), F.col("w.metric")
    best_score, worst_score = -F.col("b.neg"), F.col("w.avg_score")
    # The template is cut at its placeholders once, so inserted labels are
    # never re-scanned for placeholders.
    values = {"best": metric_label(best), "best_score": _fmt_score(best_score),
              "worst": metric_label(worst), "worst_score": _fmt_score(worst_score)}
    pieces = re.split(r"\{(\w+)\}", EXEC_SUMMARY_TEMPLATE)
    text = F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(pieces)])
    return out.select(best.alias("best_metric"), best_score.alias("best_score"),
                      worst.alias("worst_metric"), worst_score.alias("worst_score"),
                      "total_meetings", text.alias("summary_text"))


def score_matrix(meetings: DataFrame, metrics: list[str]) -> DataFrame:
    """AG-10: meeting x metric pivot, absent -> NULL. The metric list is
    passed explicitly (no extra job to find pivot values)."""
    return matrix_of(scores_long(meetings), metrics)


def matrix_of(scores: DataFrame, metrics: list[str]) -> DataFrame:
    return (scores.groupBy("sales_id", "id").pivot("metric", metrics).agg(F.max("value"))
            .withColumnRenamed("id", "meeting_id"))


def score_maps(scores: DataFrame) -> DataFrame:
    """AG-10 for an open set of metrics: one row per meeting with a map
    ``metric -> value``, metrics in text order. No list of all metrics is
    needed; a map is bounded by one meeting's own metrics."""
    one = scores.groupBy("sales_id", "id", "metric").agg(F.max("value").alias("value"))
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return (one.groupBy("sales_id", "id").agg(F.map_from_entries(entries).alias("scores"))
            .withColumnRenamed("id", "meeting_id"))


def metric_timeline(meetings: DataFrame) -> DataFrame:
    """ST-5: score series per metric over meetings. ``parley.operators.
    ordering.positioned`` puts it in order, newest first."""
    return timeline_of(scores_long(meetings))


def timeline_of(s: DataFrame) -> DataFrame:
    return s.select("metric", metric_label("metric").alias("metric_label"), "id", "sales_id", "meeting_ts",
                    display_ts("meeting_ts").alias("meeting_date"), "pos", "value")


def skill_table(meetings: DataFrame) -> DataFrame:
    """PRJ-20: per meeting, one row per skill: label and score in JSON
    order."""
    s = scores_long(meetings)
    return s.select(F.col("id").alias("meeting_id"), "sales_id", "pos", "metric",
                    metric_label("metric").alias("skill"), F.col("value").alias("score"))


def agent_meetings(meetings: DataFrame, sales_id: str) -> DataFrame:
    """PRJ-5: one agent's meetings (a pushed-down filter on ``sales_id``)."""
    return meetings.filter(F.col("sales_id") == F.lit(sales_id))
