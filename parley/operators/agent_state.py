"""Per-agent score state kept beside the meetings (AG-1..3, AG-6, WN-1).

The state is a table of mergeable summaries, one folder per batch of new
meetings (``batch=<name>``, say a day). Scores are merged from it: new meetings
cost their own rows, and no history is scanned again. A batch that is written
twice replaces itself. ``compact`` folds the batches into one row per agent and
metric, so that a read stays small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.operators import scoring
from parley.session import stored


def _folder(path: str, batch: str) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


def append(meetings: DataFrame, path: str, batch: str) -> None:
    """Add a batch of new meetings (each stored meeting belongs to one batch)."""
    scoring.agent_summary(meetings).write.mode("overwrite").parquet(_folder(path, batch))


def summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def score_cards(spark: SparkSession, path: str) -> DataFrame:
    """:func:`scoring.weighted_score_cards` of all batches."""
    return scoring.cards_of(scoring.weighted_table(summary(spark, path)))


def agent_profile(spark: SparkSession, path: str) -> DataFrame:
    """:func:`scoring.agent_profile` of all batches."""
    return scoring.profile_of(scoring.weighted_table(summary(spark, path)))


def compact(spark: SparkSession, path: str, target: str, batch: str = "compacted") -> None:
    """Write the merged summary of all batches under ``path`` as the one batch
    of a new state ``target``; the old one may then be dropped."""
    stored(scoring.merged_summary(summary(spark, path)), "compacted").write.mode("overwrite").parquet(_folder(target, batch))
