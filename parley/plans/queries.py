"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole driver tables (through the fixture views)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley import fixtures as fx
from parley.functions import text as tx
from parley.operators import agent_state, inference, matching, meetings, outbox, rules, scoring
from parley.operators.ordering import positioned
from parley.session import dealt, scratch, stored
from parley.plans import flows
from parley.sources import corpus as corpus_src
from parley.streaming import delivery, ingest

QueryFn = Callable[[SparkSession, str], DataFrame]


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.meetings_json(spark, sf_dir)


# --- scoring (WN/AG/PRJ) -------------------------------------------------

def q_weighted_scores(spark, sf_dir):
    return scoring.weighted_score_cards(_meetings(spark, sf_dir))


def q_agent_profile(spark, sf_dir):
    return scoring.agent_profile(_meetings(spark, sf_dir))


def q_agent_state_scores(spark, sf_dir):
    """AG-3 from kept state: the meetings arrive in three batches by day, the
    last of them twice, on top of a compacted state."""
    m = _meetings(spark, sf_dir).withColumn("part", F.dayofmonth("meeting_ts") % 3)
    first, path = scratch(spark, "state"), scratch(spark, "state")
    for part in (0, 1):
        agent_state.append(m.filter(F.col("part") == part).drop("part"), first, f"day-{part}")
    agent_state.compact(spark, first, path)
    for _ in range(2):
        agent_state.append(m.filter("part = 2").drop("part"), path, "day-2")
    return agent_state.score_cards(spark, path)


def q_latest_scores(spark, sf_dir):
    return scoring.latest_scores(_meetings(spark, sf_dir), 5)


def q_metric_means(spark, sf_dir):
    return scoring.metric_means(_meetings(spark, sf_dir))


def q_best_worst_global(spark, sf_dir):
    return scoring.best_worst_global(_meetings(spark, sf_dir))


def q_score_matrix(spark, sf_dir):
    return scoring.score_matrix(_meetings(spark, sf_dir), fx.FIXTURE_METRICS)


def q_score_maps(spark, sf_dir):
    """AG-10 for an open set of metrics, each map as text."""
    maps = scoring.score_maps(scoring.scores_long(_meetings(spark, sf_dir)))
    text = F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("sales_id", "meeting_id", F.array_join(text, ",").alias("scores_text"))


def q_metric_timeline(spark, sf_dir):
    """ST-5: per metric, newest meeting first."""
    lines = scoring.metric_timeline(_meetings(spark, sf_dir))
    order = [("metric", True), ("meeting_ts", False), ("id", False), ("sales_id", True), ("pos", True)]
    return positioned(lines, order).drop("meeting_ts")


def q_skill_table(spark, sf_dir):
    return scoring.skill_table(_meetings(spark, sf_dir))


# --- text functions (SC-*) ---------------------------------------------------

def q_text_cleaning(spark, sf_dir):
    d = dealt(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id",
                    tx.clean_text(tx.head_chars("text", 2000)).alias("head_clean"),
                    tx.summarize("text").alias("summary"),
                    tx.clean_extracted("text").alias("extracted"),
                    F.length(tx.strip("text")).cast("bigint").alias("stripped_chars"))


# --- rules (RL-*, JN-2, JN-3) --------------------------------------------------

def q_transcript_rules(spark, sf_dir):
    t = fx.transcripts(spark, sf_dir)
    c = rules.classify_transcripts(meetings.valid_transcripts(t), "text", fx.fixture_words())
    return c.select("conv_id", "client_name", "objection", "topic_phrase", "followup_3", "followup_4")


def q_detect_sectors(spark, sf_dir):
    t = fx.transcripts(spark, sf_dir)
    return t.select("conv_id", F.explode(rules.detected_sectors("text", fx.fixture_words())).alias("sector"))


def q_detect_sectors_lexicon(spark, sf_dir):
    """JN-3 + AG-7 with a lexicon held as a table: the words of the benchmark
    items, the sector being a word's first letter."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0)))
    lexicon = fx.table(spark, sf_dir, "benchmark").select(words.alias("keyword")).select("keyword", F.substring("keyword", 1, 1).alias("sector"))
    return rules.detect_sectors_join(fx.transcripts(spark, sf_dir), lexicon)


def q_describe_documents(spark, sf_dir):
    corpus = fx.corpus(spark, sf_dir)
    cache = corpus.filter(F.col("sector") == "Marketing").select("name", "text", "ordinal")
    d = rules.describe_documents(corpus.select("sector", "name", "ordinal"), cache, fx.fixture_words())
    return d.select("sector", "name", "ordinal", tx.document_stem("name").alias("stem"), "description")


# --- topics and matching (LM-1 offline, JN-3..7, ST-2/3, AG-8/11) -------------

def q_meeting_topics(spark, sf_dir):
    return inference.keyword_topics(fx.transcripts(spark, sf_dir), "conv_id")


def q_match_documents(spark, sf_dir):
    t = fx.transcripts(spark, sf_dir)
    topics = inference.keyword_topics(t, "conv_id")
    corpus = fx.corpus(spark, sf_dir)
    m = matching.match_documents(topics, corpus, key="conv_id")
    return matching.matched_summaries(m, corpus)


def q_rank_by_name(spark, sf_dir):
    t = fx.transcripts(spark, sf_dir)
    sectors = t.select("conv_id", F.explode(rules.detected_sectors("text", fx.fixture_words())).alias("sector"))
    return matching.rank_by_name(t, sectors, fx.corpus(spark, sf_dir), key="conv_id")


def q_rule_followups(spark, sf_dir):
    """PL-1: the full 11-field follow-up record per transcript."""
    corpus = fx.corpus(spark, sf_dir)
    cache = corpus.filter(F.col("sector") == "Marketing").select("name", "text", "ordinal")
    records = flows.generate_followups(fx.transcripts(spark, sf_dir), corpus.select("sector", "name"), cache,
                                       "conv_id", fx.fixture_words())
    return records.withColumn("schedule", F.to_json("schedule"))


def q_plan_prompts(spark, sf_dir):
    """LM-1 (offline) -> JN-6 -> JN-7/SC-4 -> AG-11 -> LM-2 per transcript."""
    t = fx.transcripts(spark, sf_dir)
    analysis = inference.analyze_transcripts(t, "conv_id", None, fx.fixture_words())
    topics = analysis.select("conv_id", F.posexplode("analysis.topics").alias("pos", "topic"))
    corpus = fx.corpus(spark, sf_dir)
    picks = matching.matched_summaries(matching.match_documents(topics, corpus, key="conv_id"), corpus)
    blocks = matching.document_block(picks, "conv_id")
    return inference.plan_prompts(analysis, blocks, "conv_id")


# --- corpus from raw pages (SRC-5..7, AG-9) -------------------------------------

def q_corpus_from_pages(spark, sf_dir):
    files = corpus_src.pages_as_files(fx.table(spark, sf_dir, "pages"))
    return corpus_src.build_corpus(files)


# --- stored meetings (SNK-1, PRJ-*) ---------------------------------------------

def q_archive(spark, sf_dir):
    return positioned(meetings.archive(_meetings(spark, sf_dir)), meetings.NEWEST_FIRST).drop("meeting_ts")


# The page of the archive that is read, and its size.
PAGE, PAGE_SIZE = 3, 100


def q_archive_page(spark, sf_dir):
    """ST-1 + PL-4: a page of the archive, from meetings stored by day."""
    path = scratch(spark, "by-day")
    meetings.write_by_day(_meetings(spark, sf_dir), path)
    return meetings.archive_page(spark, path, PAGE, PAGE_SIZE).drop("meeting_ts")


def q_meetings_by_date(spark, sf_dir):
    """SRC-3: the stored meetings in the order they are loaded."""
    return positioned(_meetings(spark, sf_dir).select("id", "sales_id", "meeting_ts"), meetings.NEWEST_FIRST).drop("meeting_ts")


def q_stamped_meetings(spark, sf_dir):
    """PRJ-1 + PRJ-2: id and date from the time, scores from the plan."""
    m = _meetings(spark, sf_dir).select(F.col("id").alias("stored_id"), "sales_id", "meeting_ts", "followup_json")
    return meetings.stamp_meetings(m).select("id", "sales_id", "meeting_date",
                                             meetings.extract_scoring(F.col("followup_json")).alias("scoring"))


def q_decoded_meetings(spark, sf_dir):
    d, _ = meetings.decode_meetings(_meetings(spark, sf_dir))
    obj = F.col("analysis.objection")
    return d.select(
        "id", "sales_id", F.col("analysis.summary").alias("summary"),
        F.when(obj != "", obj).alias("objection"),
        F.size("analysis.topics").cast("bigint").alias("n_topics"),
        F.col("pdfs")[0]["name"].alias("first_pdf"),
        F.size(meetings.followup_entries(F.col("followup"))).cast("bigint").alias("n_followups"),
        F.size("scoring").cast("bigint").alias("n_scores"))


def q_topic_rows(spark, sf_dir):
    d, _ = meetings.decode_meetings(_meetings(spark, sf_dir))
    return meetings.meeting_topics(d).withColumn("pos", F.col("pos").cast("bigint"))


def q_followup_cards(spark, sf_dir):
    d, _ = meetings.decode_meetings(_meetings(spark, sf_dir))
    return meetings.followup_cards(d).drop("attachments", "position")


# --- the odd forms of stored JSON ------------------------------------------------

def _varied(spark, sf_dir):
    return meetings.decode_meetings(fx.meetings_varied(spark, sf_dir))


def q_varied_cards(spark, sf_dir):
    """PRJ-9 + ST-4."""
    return meetings.followup_cards(_varied(spark, sf_dir)[0]).drop("attachments").withColumn(
        "position", F.col("position").cast("bigint"))


def q_varied_attachments(spark, sf_dir):
    """PRJ-10 + PRJ-11."""
    return meetings.followup_attachments(_varied(spark, sf_dir)[0])


def q_varied_mistakes(spark, sf_dir):
    """PRJ-12."""
    return meetings.mistakes(_varied(spark, sf_dir)[0]).withColumn("pos", F.col("pos").cast("bigint"))


def q_varied_missed(spark, sf_dir):
    """PRJ-13."""
    return meetings.missed_opportunities(_varied(spark, sf_dir)[0]).withColumn("pos", F.col("pos").cast("bigint"))


def q_varied_rejects(spark, sf_dir):
    """PRJ-4: rows whose JSON is cut off."""
    return _varied(spark, sf_dir)[1].select("id", "analysis_json", "scoring_json")


def q_varied_reports(spark, sf_dir):
    """PRJ-21 + PRJ-7: the whole report of each meeting, lists as text."""
    r = meetings.meeting_report(_varied(spark, sf_dir)[0])
    card = F.transform("followups", lambda f: F.concat(
        f["key"], F.lit("="), f["subject"], F.lit("/"), f["body"], F.lit("/"),
        F.array_join(F.transform(f["attachments"], lambda a: F.concat(a["name"], F.lit(":"), a["description"])), ",")))
    return r.select("id", "sales_id", "meeting_date", "summary", "objection", F.array_join("topics", "|").alias("topics"),
                    F.array_join("mistakes", "|").alias("mistakes"), F.array_join("missed", "|").alias("missed"),
                    F.array_join(card, ";").alias("followups"), F.size("scores").cast("bigint").alias("n_scores"))


def q_varied_means(spark, sf_dir):
    """AG-4 with exact digits."""
    return scoring.metric_means(fx.meetings_varied(spark, sf_dir))


def q_score_rejects(spark, sf_dir):
    """SC-8: score entries that are not finite numbers in range."""
    return scoring.rejected_scores(fx.meetings_varied(spark, sf_dir)).drop("raw")


# --- model path -------------------------------------------------------------------

def q_model_replies(spark, sf_dir):
    """LM-4: good, cut-off, incomplete and plain-text replies, told by the
    length of each conversation; parsed rows keep the whole object."""
    c = fx.transcripts(spark, sf_dir)
    good = F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("topics"), F.lit("f").alias("fears"), F.lit("o").alias("objection"),
                              F.substring("text", 1, 30).alias("summary"), F.lit("kept").alias("clarity")))
    kind = F.length("text") % 4
    reply = (F.when(kind == 0, good).when(kind == 1, F.substring(good, F.lit(1), F.length(good) - 9))
             .when(kind == 2, F.replace(good, F.lit('"fears":"f",'), F.lit(""))).otherwise(F.concat(F.lit("text: "), F.col("text"))))
    parsed, rejected = inference.parse_replies(c.select("conv_id", reply.alias("reply")), "conv_id", inference.ANALYSIS_DDL,
                                               "analysis", inference.ANALYSIS_FIELDS)
    ok = parsed.select("conv_id", F.lit(None).cast("string").alias("reason"), F.col("value.summary").alias("summary"),
                       F.array_join("value.topics", ",").alias("topics"), "reply")
    bad = rejected.select("conv_id", "reason", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("topics"), "reply")
    return ok.unionByName(bad)


def q_ingested_meetings(spark, sf_dir):
    """PL-6 without a model (LM-1, JN-6, LM-3, SNK-1): every conversation runs
    through the flow; those of stored ids (texts with ``sch``) are refused."""
    t = stored(fx.transcripts(spark, sf_dir), "transcripts")
    agents = t.select("conv_id", (F.length("text") % 20).cast("string").alias("sales_id"),
                      (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("conv_id").cast("int"))).alias("meeting_ts"))
    kept = t.filter(F.contains("text", F.lit("sch"))).join(agents, "conv_id")
    saved, rejected, _ = flows.ingest(meetings.stamp_meetings(kept.select("meeting_ts")).select("id"), t, agents, fx.corpus(spark, sf_dir), "conv_id",
                                      words=fx.fixture_words())
    both = saved.withColumn("copies", F.lit(0).cast("bigint")).unionByName(rejected)
    return both.select("id", "sales_id", "analysis_json", "pdfs_json", "followup_json", "scoring_json", "copies")


def q_streamed_arrivals(spark, sf_dir):
    """STR-1: transcripts arrive as a stream of files; those of even length
    arrive again with another text and are rejected."""
    place = scratch(spark, "arrivals")
    t = fx.transcripts(spark, sf_dir).select(F.col("conv_id").cast("string").alias("meeting_id"), "text")
    t.repartition(4).write.parquet(f"{place}/in")
    first = spark.read.schema(t.schema).parquet(f"{place}/in")
    again = first.filter("length(text) % 2 = 0").select("meeting_id", F.concat(F.lit("blest: "), "text").alias("text"))
    stored(again, "again").write.mode("append").parquet(f"{place}/in")
    source = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")

    def build(batch):
        return (rules.classify_transcripts(meetings.valid_transcripts(batch), "text", fx.fixture_words())
                .select("meeting_id", "client_name", "objection", "topic_phrase"))

    stream = ingest.stream_records(source, f"{place}/out", f"{place}/state", build, f"{place}/no", once=True)
    stream.awaitTermination()
    no = ingest.read_records(spark, f"{place}/no").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("rejected"))
    return (ingest.read_records(spark, f"{place}/out").join(no, "meeting_id", "left")
            .select("meeting_id", "client_name", "objection", "topic_phrase", F.coalesce("rejected", F.lit(0)).alias("rejected")))


def fixture_model(prompt: str) -> str:
    """Stands for the model: a request that holds ``sch`` gets a reply that is
    cut off, one that holds ``nicht`` an error, others a whole analysis."""
    if "nicht" in prompt:
        raise RuntimeError("busy")
    text = prompt.removeprefix(inference.ANALYSIS_SYSTEM + "\n\n" + inference.ANALYSIS_USER_PREFIX)
    reply = json.dumps({"topics": [text[:5], str(len(prompt))], "fears": "", "objection": "none", "summary": text[:40]}, ensure_ascii=False)
    return reply[:-4] if "sch" in prompt else reply


def q_stored_replies(spark, sf_dir):
    """LM-1 + LM-4 over a reply table: every conversation twice, under two
    keys; a second run that allows one more try; a third that sends nothing.
    ``attempts`` are the tries of the conversation's request."""
    t = stored(fx.transcripts(spark, sf_dir), "transcripts")
    both = t.unionByName(t.withColumn("conv_id", -1 - F.col("conv_id")))
    path = scratch(spark, "replies")
    for attempts in (1, 2, 2):
        parsed, rejected = inference.analyze(both, "conv_id", fixture_model, replies=path, attempts=attempts)
    ledger = inference.reply_ledger(spark, path, "analysis").groupBy("sha").agg(F.count(F.lit(1)).alias("attempts"))
    sha = F.sha2(F.concat(F.lit("analysis\n"), "prompt").cast("binary"), 256)
    tries = inference.analysis_prompts(both, "conv_id").select("conv_id", sha.alias("sha")).join(ledger, "sha").select("conv_id", "attempts")
    good = parsed.select("conv_id", F.lit(None).cast("string").alias("reason"), F.col("analysis.summary").alias("summary"),
                         F.array_join("analysis.topics", "|").alias("topics"))
    bad = rejected.select("conv_id", "reason", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("topics"))
    return good.unionByName(bad).join(tries, "conv_id")


def _conversation_ids(spark, sf_dir):
    return fx.table(spark, sf_dir, "conversations").select("conv_id").distinct()


def q_plan_requests(spark, sf_dir):
    """LM-2: both requests for the topics of each conversation (none where it
    holds ``nicht``), with fears unless it holds ``sch``, and the document
    blocks of those of even length."""
    t = stored(fx.transcripts(spark, sf_dir), "transcripts")
    found = inference.offline_analysis(t, "conv_id", fx.fixture_words()).join(t, "conv_id")
    topics = F.concat("analysis.topics", F.array(F.lit("it's"), F.lit("a\\b")))
    a = found.select("conv_id", F.struct(
        F.when(F.contains("text", F.lit("nicht")), F.array().cast("array<string>")).otherwise(topics).alias("topics"),
        F.when(~F.contains("text", F.lit("sch")), F.concat(F.lit("fear "), F.substring("text", 1, 20))).alias("fears"),
        F.col("analysis.objection").alias("objection"), F.col("analysis.summary").alias("summary")).alias("analysis"))
    blocks = q_document_blocks(spark, sf_dir).join(t.filter("length(text) % 2 = 0").select("conv_id"), "conv_id")
    both = [inference.plan_prompts(a, blocks, "conv_id", v).withColumn("variant", F.lit(v)) for v in ("plan", "sending")]
    return both[0].unionByName(both[1])


def _picks(spark, sf_dir):
    """Documents picked for each conversation: every document belongs to one
    conversation number, and the two shortest of each are picked (some have
    one or none)."""
    c = _conversation_ids(spark, sf_dir)
    n = F.lit(c.count())
    d = fx.corpus(spark, sf_dir).select("ordinal", F.coalesce(F.length("text"), F.lit(0)).alias("size"), (F.col("ordinal") * 7919 % n).alias("k"))
    w = Window.partitionBy("conv_id").orderBy("size", "ordinal")
    return (c.withColumn("k", F.col("conv_id") % n).join(d, "k").withColumn("rank", F.row_number().over(w))
            .filter("rank <= 2").select("conv_id", "rank", "ordinal"))


def q_document_blocks(spark, sf_dir):
    """JN-7 + SC-4 + AG-11 on given picks."""
    corpus = fx.corpus(spark, sf_dir)
    picks = _picks(spark, sf_dir).join(corpus.select("ordinal", "name"), "ordinal")
    return matching.document_block(matching.matched_summaries(picks, corpus), "conv_id")


def q_followup_records(spark, sf_dir):
    """RL-5, RL-6, RL-9 and RL-10 on given picks."""
    corpus = fx.corpus(spark, sf_dir)
    picks = _picks(spark, sf_dir).join(corpus.select("ordinal", "sector", "name"), "ordinal").withColumn("description", F.col("sector"))
    t = fx.transcripts(spark, sf_dir)
    r = rules.build_followup_record(rules.classify_transcripts(meetings.valid_transcripts(t), "text", fx.fixture_words()), picks, "conv_id")
    return r.withColumn("schedule", F.to_json("schedule"))


def q_report_headers(spark, sf_dir):
    """PRJ-21 + PRJ-7: the scalar fields of each case report."""
    d, _ = meetings.decode_meetings(_meetings(spark, sf_dir))
    r = meetings.meeting_report(d)
    return r.select("id", "sales_id", "meeting_date", "summary", "objection",
                    F.size("topics").cast("bigint").alias("n_topics"),
                    F.size("followups").cast("bigint").alias("n_followups"),
                    F.col("followups")[0]["subject"].alias("first_subject"),
                    F.size("scores").cast("bigint").alias("n_scores"), "chart_key")


def q_mistake_rows(spark, sf_dir):
    d, _ = meetings.decode_meetings(_meetings(spark, sf_dir))
    return meetings.mistakes(d).withColumn("pos", F.col("pos").cast("bigint"))


def q_missed_rows(spark, sf_dir):
    d, _ = meetings.decode_meetings(_meetings(spark, sf_dir))
    return meetings.missed_opportunities(d).withColumn("pos", F.col("pos").cast("bigint"))


def q_meeting_reports(spark, sf_dir):
    d, _ = meetings.decode_meetings(_meetings(spark, sf_dir))
    return meetings.meeting_report(d)


# Fixed value: the fixture's "already stored" cut-off for the save check.
SAVED_BEFORE = "2024-01-16"


def q_save_meetings(spark, sf_dir):
    m = _meetings(spark, sf_dir)
    existing = m.filter(F.col("meeting_ts") < F.lit(SAVED_BEFORE).cast("timestamp_ntz"))
    saved, _ = meetings.save_meetings(existing, m)
    return saved.select("id", "sales_id", tx.display_ts("meeting_ts").alias("meeting_date"))


# --- outbox (OB-1, OB-2) ------------------------------------------------------------

def _plans(spark, sf_dir):
    return _meetings(spark, sf_dir).select(F.col("id").alias("meeting_id"),
                                           F.col("meeting_ts").alias("planned_at"), "followup_json")


def q_outbox(spark, sf_dir):
    return outbox.build_outbox(_plans(spark, sf_dir)).select(
        "meeting_id", "key", "message", "send_at_text", "slot")


# Fixed value: meetings planned before this day had their first message sent.
SENT_BEFORE = "2024-01-10"


def q_due_messages(spark, sf_dir):
    box = outbox.build_outbox(_plans(spark, sf_dir))
    now = box.select(F.max("registered_at")).scalar()
    first = outbox.first_run(F.col("registered_at"), F.col("send_at"))
    sent = (box.filter(F.col("registered_at") < F.lit(SENT_BEFORE).cast("timestamp_ntz"))
            .select("meeting_id", "key", first.alias("occurrence")))
    due = outbox.due_messages(box, sent, now)
    return due.select("meeting_id", "key", tx.display_ts("occurrence").alias("occurrence"))


# Fixed value: when the run before this one looked for due messages.
LAST_RUN = "2024-01-20 00:00:00"


def q_due_messages_since(spark, sf_dir):
    """OB-2 as an incremental run: only what fell due since the last one."""
    box = outbox.build_outbox(_plans(spark, sf_dir))
    now = box.select(F.max("registered_at")).scalar()
    due = outbox.due_messages(box, None, now, since=F.lit(LAST_RUN).cast("timestamp_ntz"))
    return due.select("meeting_id", "key", tx.display_ts("occurrence").alias("occurrence"))


def q_streamed_deliveries(spark, sf_dir):
    """OB-1 + OB-2 as a stream: all messages are registered, then the clock
    ticks at the last run, at noon some days later, and at the end. Meetings of
    one id are one registration, that of the smallest agent."""
    plans = _plans(spark, sf_dir)
    first = plans.groupBy("meeting_id").agg(F.min(F.struct("planned_at", "followup_json")).alias("p")).select("meeting_id", "p.*")
    box = stored(outbox.build_outbox(first), "outbox")
    place = scratch(spark, "deliveries")
    rows = delivery.registrations(box)
    rows.write.parquet(f"{place}/in")
    clock = box.agg(F.max("registered_at").alias("now")).unionByName(
        spark.range(1).select(F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in (LAST_RUN, "2024-01-23 12:00:00")])).alias("now")))
    for now in (F.min("now"), F.sort_array(F.collect_list("now"))[1], F.max("now")):
        delivery.ticks(clock.agg(now.alias("now")), "now").coalesce(1).write.mode("append").parquet(f"{place}/clock")
    # All registrations in the first batch, and one tick in each; a tick's timers
    # fire in the batch after it.
    source = spark.readStream.schema(rows.schema).parquet(f"{place}/in").unionByName(
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/clock"))
    stream = delivery.stream_deliveries(source, f"{place}/sent", f"{place}/state", once=True)
    stream.awaitTermination()
    return delivery.sent_messages(spark, f"{place}/sent").select("meeting_id", "key", "message", tx.display_ts("occurrence").alias("occurrence"))


QUERIES: dict[str, QueryFn] = {
    "weighted_scores": q_weighted_scores,
    "agent_profile": q_agent_profile,
    "latest_scores": q_latest_scores,
    "metric_means": q_metric_means,
    "best_worst_global": q_best_worst_global,
    "score_matrix": q_score_matrix,
    "metric_timeline": q_metric_timeline,
    "skill_table": q_skill_table,
    "text_cleaning": q_text_cleaning,
    "transcript_rules": q_transcript_rules,
    "detect_sectors": q_detect_sectors,
    "describe_documents": q_describe_documents,
    "meeting_topics": q_meeting_topics,
    "match_documents": q_match_documents,
    "rank_by_name": q_rank_by_name,
    "rule_followups": q_rule_followups,
    "plan_prompts": q_plan_prompts,
    "corpus_from_pages": q_corpus_from_pages,
    "archive": q_archive,
    "decoded_meetings": q_decoded_meetings,
    "topic_rows": q_topic_rows,
    "followup_cards": q_followup_cards,
    "meeting_reports": q_meeting_reports,
    "report_headers": q_report_headers,
    "mistake_rows": q_mistake_rows,
    "missed_rows": q_missed_rows,
    "save_meetings": q_save_meetings,
    "outbox": q_outbox,
    "due_messages": q_due_messages,
    "due_messages_since": q_due_messages_since,
    "score_maps": q_score_maps,
    "meetings_by_date": q_meetings_by_date,
    "stamped_meetings": q_stamped_meetings,
    "varied_cards": q_varied_cards,
    "varied_attachments": q_varied_attachments,
    "varied_mistakes": q_varied_mistakes,
    "varied_missed": q_varied_missed,
    "varied_rejects": q_varied_rejects,
    "varied_reports": q_varied_reports,
    "varied_means": q_varied_means,
    "score_rejects": q_score_rejects,
    "model_replies": q_model_replies,
    "plan_requests": q_plan_requests,
    "document_blocks": q_document_blocks,
    "followup_records": q_followup_records,
    "ingested_meetings": q_ingested_meetings,
    "streamed_arrivals": q_streamed_arrivals,
    "stored_replies": q_stored_replies,
    "detect_sectors_lexicon": q_detect_sectors_lexicon,
    "agent_state_scores": q_agent_state_scores,
    "streamed_deliveries": q_streamed_deliveries,
    "archive_page": q_archive_page,
}
