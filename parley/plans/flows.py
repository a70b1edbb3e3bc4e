"""Composite entry points (LM-5, PL-1, PL-6): whole-table versions of the
reference's per-transcript calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import inference, matching, meetings, rules


def generate_followups(transcripts: DataFrame, catalog: DataFrame, cache: DataFrame, key: str,
                       words: rules.RuleWords = rules.DEFAULT_WORDS) -> DataFrame:
    """PL-1 (RL-10): the 11-field follow-up record for every transcript
    ``(key, text)``: blank texts dropped, client name, objection, sectors,
    the two best files of those sectors by name (JN-3..5, ST-2), their
    descriptions (JN-2, RL-1), the four messages and the schedule.

    ``catalog``: ``(sector, name)`` of the sector folders; ``cache``:
    ``(name, text[, ordinal])`` of cached document texts."""
    t = meetings.valid_transcripts(transcripts)
    sectors = t.select(key, F.explode(rules.detected_sectors("text", words)).alias("sector"))
    picks = matching.rank_by_name(t, sectors, catalog, key=key)
    described = rules.describe_documents(picks, cache, words)
    return rules.build_followup_record(rules.classify_transcripts(t, "text", words), described, key)


def model_flow(transcripts: DataFrame, corpus: DataFrame, key: str,
               analyze: Callable[[str], str] | None = None,
               plan: Callable[[str], str] | None = None,
               words: rules.RuleWords = rules.DEFAULT_WORDS, concurrency: int = 1,
               variant: str = "plan", replies: str | None = None, attempts: int = 1) -> dict[str, DataFrame]:
    """LM-5: analyze -> match documents on the topics -> summarise the
    chosen documents -> plan prompt -> plan, for every transcript at once.

    Returns ``analysis``, ``documents`` (key, rank, name, summary),
    ``prompts``, ``rejected`` (the unusable replies of both calls with key,
    stage, text and reason) and ``plans``: the model's, or without ``plan``
    those of the rules. ``replies`` and ``attempts``: see
    :func:`parley.operators.inference.ask`."""
    analysis, rejected = inference.analyze(transcripts, key, analyze, words, concurrency, replies, attempts)
    topics = analysis.select(key, F.posexplode("analysis.topics").alias("pos", "topic"))
    docs = matching.matched_summaries(matching.match_documents(topics, corpus, key=key), corpus)
    prompts = inference.plan_prompts(analysis, matching.document_block(docs, key), key, variant)
    out = {"analysis": analysis, "documents": docs.select(key, "rank", "name", "summary"), "prompts": prompts,
           "rejected": rejected}
    if plan is not None:
        out["plans"], bad = inference.plan_followups(prompts, key, plan, concurrency, replies, attempts)
        out["rejected"] = rejected.unionByName(bad)
    else:
        out["plans"] = inference.offline_plans(transcripts.join(analysis.select(key), key, "left_semi"), out["documents"], key, words)
    return out


def meeting_rows(analysis: DataFrame, documents: DataFrame, plans: DataFrame, key: str,
                 agents: DataFrame, ts_col: str = "meeting_ts") -> DataFrame:
    """Assemble stored meeting rows from a model run: ``agents`` gives
    ``(key, sales_id, meeting_ts)``; ids are stamped from the timestamp. A
    transcript without an analysis or without a plan gives no row, so a later
    good run can still store it. The whole analysis object is stored."""
    pdfs = (documents.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "name", "summary"))).alias("d"))
            .select(key, F.to_json(F.transform("d", lambda x: F.array(x["name"], x["summary"]))).alias("pdfs_json")))
    rows = (agents.join(analysis, key).join(plans, key).join(pdfs, key, "left")
            .select(key, "sales_id", F.col(ts_col).alias("meeting_ts"), "analysis_json",
                    F.coalesce("pdfs_json", F.lit("[]")).alias("pdfs_json"), "followup_json"))
    rows = rows.withColumn("scoring_json", meetings.extract_scoring(F.col("followup_json")))
    return meetings.stamp_meetings(rows).drop("meeting_date")


def ingest(existing: DataFrame, transcripts: DataFrame, agents: DataFrame, corpus: DataFrame, key: str,
           analyze: Callable[[str], str] | None = None, plan: Callable[[str], str] | None = None,
           words: rules.RuleWords = rules.DEFAULT_WORDS, replies: str | None = None,
           attempts: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PL-6 in batch: drop blank transcripts, run the model flow, and keep
    meetings whose id is not stored yet. Returns ``(saved, rejected,
    failed)``: append ``saved`` to the meetings table; ``rejected`` are rows
    with a stored id, ``failed`` the model replies that could not be used.
    Without a ``plan`` callable the rules write the plans."""
    run = model_flow(meetings.valid_transcripts(transcripts), corpus, key, analyze, plan, words, replies=replies, attempts=attempts)
    rows = meeting_rows(run["analysis"], run["documents"], run["plans"], key, agents)
    cols = ["id", "sales_id", "meeting_ts", "analysis_json", "pdfs_json", "followup_json", "scoring_json"]
    return *meetings.save_meetings(existing, rows.select(*cols)), run["rejected"]
