"""Timed follow-up messages (OB-1, OB-2, SC-14).

The reference stamps every plan entry with ``send_at = now + 1 minute`` and
registers a job that fires *every day* at that minute, then polls the clock.
Here the outbox is a table and "what is due at ``now``" is a query: each
message's daily occurrences up to ``now`` minus those already sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.jsonfn import object_entries

# The delay before a message is sent, and display formats.
SEND_DELAY_MINUTES = 1
SEND_AT_FORMAT = "yyyy-MM-dd HH:mm:ss"
SLOT_FORMAT = "HH:mm"
FOLLOWUP_PREFIX = "followup_"


def build_outbox(plans: DataFrame, key: str = "meeting_id", now_col: str = "planned_at",
                 delay_minutes: int = SEND_DELAY_MINUTES, all_keys: bool = False) -> DataFrame:
    """OB-1: one message per plan entry with ``send_at = now + delay``.

    ``plans``: ``(key, now_col, followup_json)``. By default only
    ``followup_*`` entries become messages; ``all_keys=True`` reproduces the
    reference, which wraps every key (scores too). The message is the raw
    JSON value text (a string value without its quotes)."""
    e = object_entries(plans, "followup_json", [key, now_col], key_name="key", value_name="message")
    if not all_keys:
        e = e.filter(F.col("key").startswith(FOLLOWUP_PREFIX))
    send_at = F.col(now_col) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(delay_minutes), F.lit(0))
    return e.select(key, "key", "message", F.col(now_col).alias("registered_at"),
                    send_at.alias("send_at"),
                    F.date_format(send_at, SEND_AT_FORMAT).alias("send_at_text"),
                    F.date_format(send_at, SLOT_FORMAT).alias("slot"))


def first_run(registered_at: Column, send_at: Column) -> Column:
    """The first daily run of a job registered at ``registered_at`` for the
    minute of ``send_at``: that minute today if still ahead, else tomorrow."""
    day = F.date_trunc("day", registered_at).cast("timestamp_ntz")
    slot = F.date_trunc("minute", send_at).cast("timestamp_ntz")
    today = day + (slot - F.date_trunc("day", slot).cast("timestamp_ntz"))
    return F.when(today > registered_at, today).otherwise(today + F.expr("INTERVAL 1 DAY"))


def due_messages(outbox: DataFrame, sent: DataFrame | None, now: Column,
                 key: str = "meeting_id", recurring: bool = True,
                 since: Column | None = None) -> DataFrame:
    """OB-2: occurrences due at ``now`` and not yet in the ``sent`` log
    ``(key, key, occurrence)``. ``recurring=False`` keeps only the first
    occurrence (a one-shot send).

    ``since`` (optional) makes a run incremental: only occurrences after it
    are produced, so each run's output is bounded by the days elapsed since
    the previous run rather than by the whole history."""
    first = first_run(F.col("registered_at"), F.col("send_at"))
    if recurring:
        start = first
        if since is not None:
            # The first daily occurrence strictly after ``since``.
            days = F.greatest(F.lit(0), F.floor(
                (F.unix_micros(since.cast("timestamp")) - F.unix_micros(first.cast("timestamp")))
                / F.lit(86_400_000_000)) + 1).cast("int")
            start = F.when(first > since, first).otherwise(F.date_add(F.to_date(first), days).cast("timestamp_ntz")
                                                          + (first - F.date_trunc("day", first).cast("timestamp_ntz")))
        occ = F.explode(F.sequence(start, F.greatest(now, start), F.expr("INTERVAL 1 DAY")))
    else:
        occ = F.explode(F.array(first))
    due = (outbox.select(key, "key", "message", occ.alias("occurrence"))
           .filter(F.col("occurrence") <= now))
    if since is not None:
        due = due.filter(F.col("occurrence") > since)
    if sent is not None:
        due = due.join(sent.select(key, "key", "occurrence"), [key, "key", "occurrence"], "left_anti")
    return due
