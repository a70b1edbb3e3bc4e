"""Stored meetings: stamping, JSON encode/decode, save with id check, and
the per-meeting views (SNK-1, JN-1, PRJ-1..4, PRJ-7..15, PRJ-18/19/21,
PRJ-23, ST-1, ST-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.jsonfn import is_object_text, json_field, object_map
from parley.functions.text import display_ts, meeting_key, snippet, strip
from parley.schemas import ANALYSIS_SCHEMA

# Texts shown when a field is missing or a list is empty.
DEFAULT_SUMMARY = "No summary available."
DEFAULT_SUBJECT_REPORT = "Follow-up Email"
DEFAULT_SUBJECT_RESULTS = "No subject"
DEFAULT_ATTACHMENT_NAME = "file.pdf"
DEFAULT_AGENT = "N/A"
NO_MISTAKES = "No mistakes detected."
NO_MISSED = "No missed opportunities."
FOLLOWUP_PREFIX = "followup_"
# PRJ-11: the "why this PDF helps" sentence around the follow-up subject.
ATTACHMENT_REASON = ("This PDF reinforces the topic <b>{subject}</b> \n"
                     "                                    and helps the client fully understand the solution.")


def stamp_meetings(df: DataFrame, ts_col: str = "meeting_ts") -> DataFrame:
    """PRJ-1: id ``yyyyMMdd-HHmmss`` and ISO date from a timestamp column
    (an argument, not the wall clock, so runs repeat). Python's isoformat
    drops the fraction when it is zero; so does this."""
    ts = F.col(ts_col)
    frac = F.date_format(ts, "SSSSSS")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                   F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    return df.withColumn("id", F.date_format(ts, "yyyyMMdd-HHmmss")).withColumn("meeting_date", iso)


def extract_scoring(followup_json) -> Column:
    """PRJ-2: the ``sales_scoring`` object of a plan, ``{}`` if absent."""
    return F.coalesce(json_field(followup_json, "$.sales_scoring"), F.lit("{}"))


def raw_map_json(m: Column) -> Column:
    """A ``map<string,string>`` of JSON values as one JSON object: values that
    are JSON objects or arrays go in as they are, others as JSON strings."""
    def value(v):
        nested = F.json_object_keys(v).isNotNull() | F.json_array_length(v).isNotNull()
        text = F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
        return F.when(v.isNull(), F.lit("null")).when(nested, v).otherwise(text)

    def key(k):
        return F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)

    parts = F.transform(F.map_entries(m), lambda e: F.concat(key(e["key"]), F.lit(":"), value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def encode_meeting(df: DataFrame) -> DataFrame:
    """PRJ-3: nested columns ``analysis``, ``pdfs``, ``followup`` to JSON
    text (non-ASCII kept raw), and the scoring extracted from the plan."""
    pdfs, followup = F.col("pdfs"), F.to_json("followup")
    inner = df.schema["pdfs"].dataType.elementType
    if isinstance(inner, T.StructType):  # stored as pairs, as a list of tuples is
        pdfs = F.transform(pdfs, lambda p: F.array(*[p[name] for name in inner.names]))
    if dict(df.dtypes)["followup"] == "map<string,string>":
        followup = raw_map_json(F.col("followup"))
    out = df.select("id", "sales_id", "meeting_ts", F.to_json("analysis").alias("analysis_json"),
                    F.to_json(pdfs).alias("pdfs_json"), followup.alias("followup_json"))
    return out.withColumn("scoring_json", extract_scoring(F.col("followup_json")))


def decode_meetings(meetings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-4: parse the four JSON columns. Returns ``(decoded, rejected)``;
    a row whose JSON does not parse is rejected (the reference raises).

    ``pdfs`` becomes ``array<struct<name, description>>`` from the stored
    list of pairs; ``followup`` and ``scoring`` stay ``map<string,string>``
    (values typed later, see :mod:`parley.functions.jsonfn`)."""
    # A key repeated in one object keeps its last value, in every view (a
    # struct is parsed that way; maps are reduced by ``object_map``).
    a = F.from_json("analysis_json", ANALYSIS_SCHEMA)
    pairs = F.from_json("pdfs_json", "array<array<string>>")
    pdfs = F.transform(pairs, lambda p: F.struct(p[0].alias("name"), p[1].alias("description")))
    fu, sc = object_map("followup_json"), object_map("scoring_json")
    d = meetings.select("id", "sales_id", "meeting_ts", a.alias("analysis"), pdfs.alias("pdfs"),
                        fu.alias("followup"), sc.alias("scoring"),
                        "analysis_json", "pdfs_json", "followup_json", "scoring_json")
    # Validity is checked on the text: a malformed object parsed into a
    # struct yields a struct of NULLs rather than NULL.
    def bad_obj(c):
        return F.col(c).isNotNull() & F.json_object_keys(F.col(c)).isNull()

    bad = (bad_obj("analysis_json") | bad_obj("followup_json") | bad_obj("scoring_json")
           | (F.col("pdfs_json").isNotNull() & F.json_array_length("pdfs_json").isNull()))
    raw = ["analysis_json", "pdfs_json", "followup_json", "scoring_json"]
    return d.filter(~bad).drop(*raw), d.filter(bad).select("id", *raw)


def save_meetings(existing: DataFrame, new: DataFrame, order_col: str = "meeting_ts") -> tuple[DataFrame, DataFrame]:
    """SNK-1 + JN-1: rows of ``new`` whose id is not stored yet. Within the
    batch the first arrival (by ``order_col``) of an id wins, as repeated
    single inserts would. Returns ``(saved, rejected)``; write ``saved``
    with ``mode("append")``. Re-saving the same batch saves nothing.

    ``rejected`` holds each distinct rejected row once with ``copies``, its
    number of rejected copies: identical copies collapse in a partial
    aggregation instead of being regenerated one by one in a single task."""
    cols = new.columns
    rest = [c for c in cols if c not in ("id", order_col)]
    # The first arrival per id is a min over (order, row) structs: a hash
    # aggregation with map-side partial results, so an id repeated a
    # million times is not a hot task.
    first = (new.groupBy("id")
             .agg(F.min(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in rest])).alias("_f"))
             .select(*[F.col("_f._o").alias(c) if c == order_col else
                       F.col("id") if c == "id" else F.col(f"_f.{c}").alias(c) for c in cols]))
    saved = first.join(existing.select("id"), "id", "left_anti")
    # Every distinct row with its copy count; the saved row uses one copy.
    counted = new.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    kept = saved.select(*[F.col(c).alias(f"_k_{c}") for c in cols])
    same = None
    for c in cols:
        eq = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        same = eq if same is None else same & eq
    rejected = (counted.join(kept, F.col("id") == F.col("_k_id"), "left")
                .withColumn("copies", F.when(same, F.col("copies") - 1).otherwise(F.col("copies")))
                .filter(F.col("copies") > 0)
                .select(*cols, "copies"))
    return saved, rejected


def valid_transcripts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """PRJ-23: drop blank transcripts (Python ``strip``, so NBSP and other
    Unicode spaces count as blank)."""
    return df.filter(F.length(strip(F.col(text_col))) > 0)


# Order of the archive and of loaded meetings: newest first, then by id and agent.
NEWEST_FIRST = [("meeting_ts", False), ("id", False), ("sales_id", True)]


# --- per-meeting views over decoded rows ----------------------------------------

def meeting_topics(decoded: DataFrame) -> DataFrame:
    """PRJ-14: ``(id, pos, topic)`` per listed topic."""
    return decoded.select("id", "sales_id", F.posexplode(F.col("analysis.topics")).alias("pos", "topic"))


def meeting_objection(decoded: DataFrame) -> DataFrame:
    """PRJ-15: the objection, only where present and not empty."""
    o = F.col("analysis.objection")
    return decoded.select("id", "sales_id", o.alias("objection")).filter(o.isNotNull() & (o != ""))


def followup_entries(followup: Column) -> Column:
    """PRJ-8: map entries whose key starts with ``followup_``."""
    return F.map_filter(followup, lambda k, v: k.startswith(FOLLOWUP_PREFIX))


_CARD = "struct<subject:string,body:string,attachments:array<map<string,string>>>"


def _cards(decoded: DataFrame) -> DataFrame:
    e = decoded.select("id", "sales_id", F.explode(followup_entries(F.col("followup"))).alias("key", "raw"))
    card = F.when(is_object_text(F.col("raw")), F.from_json("raw", _CARD))
    return e.select("id", "sales_id", "key", card["subject"].alias("subject"),
                    F.when(card.isNotNull(), F.coalesce(card["body"], F.lit(""))).otherwise(F.col("raw")).alias("body"),
                    card["attachments"].alias("attachments"))


def followup_cards(decoded: DataFrame, default_subject: str = DEFAULT_SUBJECT_REPORT) -> DataFrame:
    """PRJ-9: one card per follow-up entry. An object value gives subject,
    body and attachments; any other value is the body itself. ST-4: cards are
    shown in text order of their keys (``followup_10`` before ``followup_2``),
    given by ``position``, their place in the meeting."""
    before = Window.partitionBy("id", "sales_id").orderBy("key")
    return (_cards(decoded).withColumn("subject", F.coalesce("subject", F.lit(default_subject)))
            .withColumn("position", F.row_number().over(before)))


def followup_attachments(decoded: DataFrame) -> DataFrame:
    """PRJ-10 + PRJ-11: one row per attachment with defaults, and the
    "why this PDF helps" sentence, in which a missing subject is empty."""
    a = _cards(decoded).select("id", "sales_id", "key", "subject", F.posexplode("attachments").alias("pos", "att"))
    return a.select("id", "sales_id", "key", F.col("pos").cast("bigint").alias("pos"), *_attachment(a["att"]),
                    attachment_reason(F.coalesce("subject", F.lit(""))).alias("reason"))


def _attachment(att: Column) -> list[Column]:
    return [F.coalesce(att["name"], F.lit(DEFAULT_ATTACHMENT_NAME)).alias("name"),
            F.coalesce(att["description"], F.lit("")).alias("description")]


def attachment_reason(subject: Column) -> Column:
    pre, post = ATTACHMENT_REASON.split("{subject}")
    return F.concat(F.lit(pre), subject, F.lit(post))


def listed_items(field: str, empty_text: str) -> Column:
    """PRJ-12/13: the items of a list field of the plan. A plain text is one
    item; nothing at all gives one fixed line."""
    raw = F.element_at(F.col("followup"), F.lit(field))
    arr = F.from_json(raw, "array<string>")
    return (F.when(F.json_array_length(raw) > 0, arr)
            .when(F.json_array_length(raw).isNull() & (F.length(raw) > 0), F.array(raw))
            .otherwise(F.array(F.lit(empty_text))))


def _listed(decoded: DataFrame, field: str, empty_text: str, out: str) -> DataFrame:
    return decoded.select("id", "sales_id", F.posexplode(listed_items(field, empty_text)).alias("pos", out))


def mistakes(decoded: DataFrame) -> DataFrame:
    """PRJ-12: listed mistakes, or one fixed line when there are none."""
    return _listed(decoded, "wrong_chat_or_action", NO_MISTAKES, "mistake")


def missed_opportunities(decoded: DataFrame) -> DataFrame:
    """PRJ-13: listed missed services, or one fixed line when none."""
    return _listed(decoded, "missed_important_service", NO_MISSED, "missed")


def with_defaults(decoded: DataFrame) -> DataFrame:
    """PRJ-7: fill the report's missing fields with the reference's texts.
    A JSON null is treated like an absent key (documented deviation)."""
    return decoded.select(
        "id", F.coalesce("sales_id", F.lit(DEFAULT_AGENT)).alias("sales_id"), "meeting_ts",
        F.coalesce(F.col("analysis.summary"), F.lit(DEFAULT_SUMMARY)).alias("summary"),
        F.coalesce(F.col("analysis.topics"), F.array().cast("array<string>")).alias("topics"),
        F.col("analysis.objection").alias("objection"),
        "followup", "scoring", "pdfs")


def meeting_report(decoded: DataFrame) -> DataFrame:
    """PRJ-21: one nested row per meeting with everything the case view
    shows: header, summary, topics, objection, mistakes, missed services,
    follow-up cards (key order) with their attachments, and the skill scores
    (JSON order)."""
    d = with_defaults(decoded)
    fu = F.array_sort(F.map_entries(followup_entries(F.col("followup"))))

    def shown(e):
        card = F.when(is_object_text(e["value"]), F.from_json(e["value"], _CARD))
        return F.struct(
            e["key"].alias("key"), F.coalesce(card["subject"], F.lit(DEFAULT_SUBJECT_REPORT)).alias("subject"),
            F.when(card.isNotNull(), F.coalesce(card["body"], F.lit(""))).otherwise(e["value"]).alias("body"),
            F.transform(F.coalesce(card["attachments"], F.array().cast("array<map<string,string>>")),
                        lambda a: F.struct(*_attachment(a))).alias("attachments"))

    cards = F.transform(fu, shown)

    return d.select(
        "id", "sales_id", display_ts("meeting_ts").alias("meeting_date"), "summary", "topics",
        F.when(F.col("objection").isNotNull() & (F.col("objection") != ""), F.col("objection")).alias("objection"),
        listed_items("wrong_chat_or_action", NO_MISTAKES).alias("mistakes"),
        listed_items("missed_important_service", NO_MISSED).alias("missed"),
        cards.alias("followups"),
        F.map_entries("scoring").alias("scores"),
        meeting_key(F.col("id"), display_ts("meeting_ts")).alias("chart_key"))


def archive(meetings: DataFrame) -> DataFrame:
    """ST-1 + PRJ-18 + PRJ-19: archive lines ``date | agent | summary cut to 60
    characters``; :data:`NEWEST_FIRST` is their order."""
    summary = F.coalesce(json_field("analysis_json", "$.summary"), F.lit(""))
    date = display_ts("meeting_ts")
    line = F.concat(F.lit(" "), date, F.lit(" | "), F.lit(" "), F.coalesce("sales_id", F.lit(DEFAULT_AGENT)), F.lit(" | "),
                    F.lit(" "), snippet(summary))
    return meetings.select("id", "sales_id", "meeting_ts", date.alias("meeting_date"),
                           snippet(summary).alias("summary_snippet"), line.alias("label"),
                           meeting_key(F.col("id"), date).alias("chart_key"))


def write_by_day(meetings: DataFrame, path: str, mode: str = "append") -> None:
    """Store meetings clustered by time: a folder per day (``day=``), newest
    first in each file. Ranges of time, not days, are dealt to the tasks, so a
    day that holds most meetings is several files."""
    n = int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    newest = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in NEWEST_FIRST]
    (meetings.withColumn("day", F.date_format("meeting_ts", "yyyy-MM-dd")).repartitionByRange(n, *newest).sortWithinPartitions(*newest)
     .write.mode(mode).partitionBy("day").parquet(path))


def archive_page(spark: SparkSession, path: str, page: int, size: int) -> DataFrame:
    """ST-1 + PL-4: one page (from 1) of the archive of :func:`write_by_day`,
    with ``position``. The number of meetings of each day comes from the files'
    footers; only the days that the page touches are read and sorted."""
    stored_ = spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("string"))
    # One row per day, newest first; meetings without a time are last.
    days = sorted(((r.day, r.n) for r in stored_.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda d: d[0] or "", reverse=True)
    lo, hi, before, touched, base = (page - 1) * size, page * size, 0, [], 0
    for day, n in days:
        if before + n > lo and before < hi:
            base = before if not touched else base
            touched.append(day)
        before += n
    wanted = F.col("day").isin([d for d in touched if d is not None])
    rows = stored_.filter((wanted | F.col("day").isNull()) if None in touched else wanted)
    newest = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in NEWEST_FIRST]
    # At most the rows up to the page's end are kept, so the window is as small.
    upto = archive(rows).orderBy(*newest).limit(max(0, hi - base))
    at = F.row_number().over(Window.orderBy(*newest)) + base
    return upto.withColumn("position", at.cast("bigint")).filter(F.col("position").between(lo + 1, hi))
