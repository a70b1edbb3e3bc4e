"""DuckDB SQL for whole flows: the ingest without a model, and the stream."""

from __future__ import annotations

from checks.match_sql import _SUMMARY, _TOPIC_PICKS
from checks.oracle_sql import _CORPUS, _M3, _TRANSCRIPTS, ORACLES, TRANSCRIPT_RULES, _clean, _fill1, _message, _q, _r

_RULED = TRANSCRIPT_RULES.replace("with ", "", 1).rsplit("select conv_id, client_name", 1)[0].split(_TRANSCRIPTS + ",", 1)[1]


def _mail(n: int, body: str) -> str:
    files = f"case when name{n} is null then [] else [{{'name': name{n}, 'description': desc{n}}}] end" if n <= 2 else "[]"
    return f"'\"followup_{n}\":' || to_json({{'subject': topic_phrase, 'body': {body}, 'attachments': {files}}})"


INGESTED = f"""
with recursive {_TRANSCRIPTS}, {_CORPUS}, {_TOPIC_PICKS}, {_RULED},
listed as (select conv_id, list(a order by pos) as topics from topics group by conv_id),
docs as (select conv_id, rank, name, {_SUMMARY.format(text=_clean('text'))} as summary from topic_picks join heads using (ordinal)),
p as (select conv_id, max(case when rank = 1 then name end) as name1, max(case when rank = 2 then name end) as name2,
             max(case when rank = 1 then summary end) as desc1, max(case when rank = 2 then summary end) as desc2,
             list([name, summary] order by rank) as pdfs
      from docs group by conv_id)
select strftime(timestamp '2024-01-01' + to_minutes(cast(conv_id as bigint)), '%Y%m%d-%H%M%S') as id,
       cast(length(text) % 20 as varchar) as sales_id,
       cast(to_json({{'topics': coalesce(topics, []), 'fears': '', 'objection': objection, 'summary': {_SUMMARY.format(text=_clean('text'))}}}) as varchar)
         as analysis_json,
       cast(to_json(coalesce(pdfs, [])) as varchar) as pdfs_json,
       '{{' || {_mail(1, _message(1))} || ',' || {_mail(2, _message(2))} || ',' || {_mail(3, _M3)} || ','
         || {_mail(4, _fill1(_r.MESSAGE_4, 'client_name'))}
         || ',"wrong_chat_or_action":[],"missed_important_service":[],"sales_scoring":{{}}}}' as followup_json,
       '{{}}' as scoring_json, cast(contains(text, 'sch') as bigint) as copies
from c left join listed using (conv_id) left join p using (conv_id)"""

ARRIVALS = f"""
with {_TRANSCRIPTS}, {_RULED}
select cast(conv_id as varchar) as meeting_id, client_name, objection, topic_phrase,
       cast(case when length(text) % 2 = 0 then 1 else 0 end as bigint) as rejected
from c"""



def _replies() -> str:
    from parley.operators import inference as _i
    n = len(_i.ANALYSIS_SYSTEM + "\n\n" + _i.ANALYSIS_USER_PREFIX + _i.ANALYSIS_USER_SUFFIX)
    return f"""
with {_TRANSCRIPTS},
twice as (select conv_id, text from fx_transcripts union all select -1 - conv_id, text from fx_transcripts),
k as (select conv_id, text, text || {_q(_i.ANALYSIS_USER_SUFFIX)} as said,
             case when contains(text, 'nicht') then 'call failed: RuntimeError: busy' when contains(text, 'sch') then 'not a JSON object' end as reason
      from twice)
select conv_id, reason, case when reason is null then substr(said, 1, 40) end as summary,
       case when reason is null then substr(said, 1, 5) || '|' || cast(length(text) + {n} as varchar) end as topics,
       cast(case when reason is null then 1 else 2 end as bigint) as attempts
from k"""


ORACLES.update({"stored_replies": _replies(), "ingested_meetings": INGESTED, "streamed_arrivals": ARRIVALS})
