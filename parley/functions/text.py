"""Text column expressions (SC-1..4, SC-9..14, PRJ-6/17/18/19).

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen. Where Python and Spark disagree on a detail (whitespace classes,
``strip`` vs ``trim``) the expression is written to reproduce Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.isspace`` set: Java's Unicode white space (``(?U)\s``)
# plus the four information separators U+001C..U+001F.
PY_SPACE_CLASS = r"(?U)[\s\x{1c}-\x{1f}]"
_PY_SPACE_RUN = PY_SPACE_CLASS + "+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """SC-3: Python ``str.strip()`` (all Unicode white space), not ``trim``
    (which removes spaces only)."""
    return F.regexp_replace(_col(c), rf"^{_PY_SPACE_RUN}|{_PY_SPACE_RUN}$", "")


def clean_text(c) -> Column:
    """SC-1: CR/LF to space, every white-space run to one space, strip."""
    collapsed = F.regexp_replace(_col(c), _PY_SPACE_RUN, " ")
    return F.regexp_replace(collapsed, r"^ | $", "")


def clean_extracted(c) -> Column:
    """SC-2: strip, newline -> space, then one pass of double space ->
    single space (three spaces become two, as in a single ``replace``)."""
    return F.replace(F.replace(strip(c), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def head_chars(c, n: int = 2000) -> Column:
    """SC-9: first ``n`` characters (code points), before any cleaning."""
    return F.substring(_col(c), 1, n)


# Words kept by the local summary and the suffix it appends.
SUMMARY_WORDS = 40
SUMMARY_SUFFIX = "..."


def summarize(c, words: int = SUMMARY_WORDS) -> Column:
    """SC-4: first ``words`` space-separated words of the cleaned text and
    ``...`` always appended (an empty text gives ``...``)."""
    parts = F.split(clean_text(c), " ", -1)
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit(SUMMARY_SUFFIX))


def document_stem(name) -> Column:
    """SC-11: remove every ``.pdf`` (case-sensitive), then lower-case."""
    return F.lower(F.replace(_col(name), F.lit(".pdf"), F.lit("")))


def base_name(path) -> Column:
    """SC-12: last path segment, for ``/`` and ``\\`` separators."""
    return F.element_at(F.split(_col(path), r"[/\\]"), -1)


def any_line(text, pred) -> Column:
    """SC-13: true when some ``\\n``-separated line satisfies ``pred``."""
    return F.exists(F.split(_col(text), "\n"), pred)


def contains_any(text, words) -> Column:
    """SC-10: plain substring test for any of ``words`` (no boundaries)."""
    t = _col(text)
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(t, F.lit(w))
    return cond


def metric_label(metric) -> Column:
    """PRJ-17: underscores to spaces, title case (``initcap``)."""
    return F.initcap(F.replace(_col(metric), F.lit("_"), F.lit(" ")))


def display_ts(ts) -> Column:
    """PRJ-6: ISO timestamp cut to the second (``[:19]``)."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


# Archive snippet length and its ellipsis.
SNIPPET_CHARS = 60
SNIPPET_SUFFIX = "..."


def snippet(text, n: int = SNIPPET_CHARS) -> Column:
    """PRJ-18: first ``n`` characters plus ``...`` only when longer."""
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(SNIPPET_SUFFIX))).otherwise(t)


def meeting_key(meeting_id, meeting_date) -> Column:
    """PRJ-19: ``"radar_" + md5(id or date)``."""
    return F.concat(F.lit("radar_"), F.md5(F.coalesce(_col(meeting_id), _col(meeting_date))))
