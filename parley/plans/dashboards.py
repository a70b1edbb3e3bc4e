"""Dashboard composites (PL-2, PL-3): every output of one page from a
single scan of the meetings.

The long score table is derived once and checkpointed to the shared
checkpoint folder; the means, best/worst, matrix and timeline all read it,
instead of re-reading and re-parsing the meetings per chart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import scoring
from parley.session import ensure_checkpoint_dir


def _matrix(scores: DataFrame, metrics: list[str] | None) -> DataFrame:
    """Wide columns when the caller names the metrics, else a map column."""
    return scoring.score_maps(scores) if metrics is None else scoring.matrix_of(scores, metrics)


def global_dashboard(meetings: DataFrame, metrics: list[str] | None = None) -> dict[str, DataFrame]:
    """PL-3: ``scores`` (long), ``means``, ``best_worst`` (with summary),
    ``matrix`` and ``timeline``. ``metrics`` fixes the matrix columns; without
    it the matrix has one map column."""
    ensure_checkpoint_dir(meetings.sparkSession)
    # A NULL-metric row per meeting carries the count of meetings without scores.
    scores = scoring.scores_long(meetings.select("id", "sales_id", "meeting_ts", "scoring_json")).checkpoint()
    per_metric = scores.groupBy("metric").agg(F.sum("units").alias("num"), F.count(F.lit(1)).alias("n"))
    total = meetings.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("string").alias("metric"), F.lit(None).cast("decimal(37,0)").alias("num"), "n")
    return {"scores": scores, "means": scoring.means_of(scores),
            "best_worst": scoring.best_worst_of(per_metric.unionByName(total)),
            "matrix": _matrix(scores, metrics), "timeline": scoring.timeline_of(scores)}


def agent_dashboard(meetings: DataFrame, n_latest: int = 5, metrics: list[str] | None = None) -> dict[str, DataFrame]:
    """PL-2: per agent ``profile`` (count, span, best/worst with bands),
    ``cards`` (weighted score, label, band per metric), ``latest`` (scores
    of the newest meetings) and ``heatmap`` (their meeting x metric
    matrix)."""
    latest = scoring.latest_scores(meetings, n_latest)
    table = scoring.weighted_table(scoring.agent_summary(meetings))
    return {"profile": scoring.profile_of(table), "cards": scoring.cards_of(table), "latest": latest, "heatmap": _matrix(latest, metrics)}
