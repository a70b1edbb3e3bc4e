"""Independent DuckDB SQL for each registered query.

Written from the reference's semantics directly on the driver's tables
(``events``, ``conversations``, ``documents``, ``pages`` ...); it does not
reuse the engine's code. Column names and types match the Spark results.
"""

from __future__ import annotations

# Fixture views as CTEs (FIXTURES.md §2.1-2.2).
_MEETINGS = """
fx_meetings as (
  select user_id, date_trunc('day', ts) as day, min(ts) as meeting_ts,
         replace(replace(replace(substr(cast(min(ts) as varchar), 1, 19), '-', ''), ':', ''), ' ', '-') as meeting_id
  from events group by user_id, date_trunc('day', ts)
),
fx_scores as (
  select user_id, date_trunc('day', ts) as day, event_type as metric,
         max(case when value >= 100 then 10 else cast(floor(value / 10) as int) end) as score
  from events where event_type <> 'error'
  group by user_id, date_trunc('day', ts), event_type
),
ranked as (
  select m.*, cast(m.user_id as varchar) as sales_id,
         row_number() over (partition by m.user_id order by m.meeting_ts desc, m.meeting_id desc) as rn
  from fx_meetings m
),
weighted as (
  select *, case when rn <= 5 then 12 - 2 * rn else 1 end as w10 from ranked
),
scored as (
  select w.sales_id, w.meeting_id, w.meeting_ts, w.rn, w.w10, s.metric, s.score,
         row_number() over (partition by w.user_id, w.day order by s.metric) - 1 as pos
  from weighted w join fx_scores s on s.user_id = w.user_id and s.day = w.day
)"""


def _label(c: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), "
            f"lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ')")


def _round2(num: str, den: str) -> str:
    return f"(cast(({num} * 200 + {den}) // (2 * {den}) as double) / 100)"


def _band(c: str) -> str:
    return f"(case when {c} >= 7.5 then 'green' when {c} >= 5 then 'amber' else 'red' end)"


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"


_AGENT_WS = f"""
den as (select sales_id, sum(w10) as den from weighted group by sales_id),
num as (select sales_id, metric, sum(score * w10) as num, min(rn) as first_rn from scored group by sales_id, metric),
ws as (select num.sales_id, num.metric, num.first_rn, {_round2('num.num', 'den.den')} as weighted_score
       from num join den on num.sales_id = den.sales_id)"""

WEIGHTED_SCORES = f"""
with {_MEETINGS}, {_AGENT_WS}
select sales_id, metric, {_label('metric')} as metric_label, weighted_score,
       {_band('weighted_score')} as band
from ws"""

AGENT_PROFILE = f"""
with {_MEETINGS}, {_AGENT_WS},
best as (select sales_id, metric as best_metric, weighted_score as best_score from (
  select *, row_number() over (partition by sales_id order by weighted_score desc, first_rn, metric) as k from ws) where k = 1),
worst as (select sales_id, metric as worst_metric, weighted_score as worst_score from (
  select *, row_number() over (partition by sales_id order by weighted_score asc, first_rn, metric) as k from ws) where k = 1),
span as (select sales_id, count(*) as meeting_count, {_ts('min(meeting_ts)')} as first_meeting,
         {_ts('max(meeting_ts)')} as last_meeting from ranked group by sales_id)
select span.sales_id, meeting_count, first_meeting, last_meeting,
       best_metric, best_score, worst_metric, worst_score,
       {_label('best_metric')} as best_label, {_label('worst_metric')} as worst_label,
       case when best_score is not null then {_band('best_score')} end as best_band,
       case when worst_score is not null then {_band('worst_score')} end as worst_band
from span left join best on span.sales_id = best.sales_id left join worst on span.sales_id = worst.sales_id"""

LATEST_SCORES = f"""
with {_MEETINGS}
select sales_id, meeting_id as id, rn as recency_rank, {_ts('meeting_ts')} as meeting_date,
       pos, metric, cast(score as double) as value
from scored where rn <= 5"""

METRIC_MEANS = f"""
with {_MEETINGS}
select metric, {_label('metric')} as metric_label,
       {_round2('sum(score)', 'count(*)')} as avg_score, count(*) as n_scores
from scored group by metric"""

BEST_WORST_GLOBAL = f"""
with {_MEETINGS},
means as (select metric, {_round2('sum(score)', 'count(*)')} as avg_score from scored group by metric),
b as (select metric, avg_score from means order by avg_score desc, metric limit 1),
w as (select metric, avg_score from means order by avg_score asc, metric limit 1)
select b.metric as best_metric, b.avg_score as best_score, w.metric as worst_metric, w.avg_score as worst_score,
       (select count(*) from fx_meetings) as total_meetings,
       '**Overall Performance Snapshot**' || chr(10) ||
       '- The strongest capability across all meetings is **' || {_label('b.metric')} || '** scoring **'
         || cast(b.avg_score as varchar) || '/10**.' || chr(10) ||
       '- The area needing the most improvement is **' || {_label('w.metric')} || '** with an average score of **'
         || cast(w.avg_score as varchar) || '/10**.' || chr(10) || chr(10) ||
       '**Recommendation**' || chr(10) ||
       '- Focus training and coaching on improving the lowest metric.' || chr(10) ||
       '- Use high-performing metrics as best-practice templates to duplicate across the team.' as summary_text
from b, w"""

SCORE_MATRIX = f"""
with {_MEETINGS}
select sales_id, meeting_id,
       max(case when metric = 'click' then cast(score as double) end) as click,
       max(case when metric = 'purchase' then cast(score as double) end) as purchase,
       max(case when metric = 'signup' then cast(score as double) end) as signup,
       max(case when metric = 'view' then cast(score as double) end) as view
from scored group by sales_id, meeting_id"""

METRIC_TIMELINE = f"""
with {_MEETINGS}
select metric, {_label('metric')} as metric_label, meeting_id as id, sales_id,
       {_ts('meeting_ts')} as meeting_date, pos, cast(score as double) as value,
       row_number() over (order by metric, meeting_ts desc, meeting_id desc, sales_id, pos) as position
from scored"""

SKILL_TABLE = f"""
with {_MEETINGS}
select meeting_id, sales_id, pos, metric, {_label('metric')} as skill, cast(score as double) as score
from scored"""

ORACLES: dict[str, str] = {
    "weighted_scores": WEIGHTED_SCORES,
    "agent_profile": AGENT_PROFILE,
    "latest_scores": LATEST_SCORES,
    "metric_means": METRIC_MEANS,
    "best_worst_global": BEST_WORST_GLOBAL,
    "score_matrix": SCORE_MATRIX,
    "metric_timeline": METRIC_TIMELINE,
    "skill_table": SKILL_TABLE,
}


# --- text and rules ------------------------------------------------------------
# Fixed texts (templates, descriptions) are data shared with the engine; the
# logic that picks and fills them below is written independently in SQL.
from parley.operators import rules as _r  # noqa: E402


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# Python's str.isspace() set, spelled out for RE2.
_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'), ' ')"


TEXT_CLEANING = f"""
select doc_id,
       {_clean('substr(text, 1, 2000)')} as head_clean,
       array_to_string(string_split({_clean('text')}, ' ')[1:40], ' ') || '...' as summary,
       replace(replace({_strip('text')}, chr(10), ' '), '  ', ' ') as extracted,
       cast(length({_strip('text')}) as bigint) as stripped_chars
from documents"""

_TRANSCRIPTS = """
fx_transcripts as (
  select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as text
  from conversations group by conv_id
)"""


def _fill1(tpl: str, name: str) -> str:
    return f"replace({_q(tpl)}, '{{client_name}}', {name})"


_M3 = "case " + " ".join(
    f"when objection = '{k}' then {_fill1(v, 'client_name')}" for k, v in _r.MESSAGE_3.items()
) + f" else {_fill1(_r.MESSAGE_3_OTHER, 'client_name')} end"

TRANSCRIPT_RULES = f"""
with {_TRANSCRIPTS},
c as (
  select conv_id, text,
         case when len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'blest') and contains(l, ':'))) > 0
              then {_q(_r.CLIENT_MARKER_NAME)} else {_q(_r.CLIENT_DEFAULT)} end as client_name,
         case when contains(lower(text), 'blest') or contains(lower(text), 'que') then 'money'
              when contains(lower(text), 'hand') then 'expectations'
              when contains(lower(text), 'sch') then 'quality'
              when contains(lower(text), 'nicht') then 'timeline'
              else 'none' end as objection,
         case when contains(text, 'hand') then {_q(_r.TOPIC_STORE)} else {_q(_r.TOPIC_GENERIC)} end as topic_phrase
  from fx_transcripts
  where length({_strip('text')}) > 0
)
select conv_id, client_name, objection, topic_phrase, {_M3} as followup_3,
       {_fill1(_r.MESSAGE_4, 'client_name')} as followup_4
from c"""

DETECT_SECTORS = f"""
with {_TRANSCRIPTS},
lex(keyword, sector) as (values ('hand','Branding'), ('blest','Sales'), ('que','Sales'),
  ('nicht','Business'), ('los','Business'), ('sch','Marketing'), ('ción','Marketing'))
select distinct t.conv_id, l.sector
from fx_transcripts t join lex l on contains(lower(t.text), l.keyword)"""

_CORPUS = """
fx_corpus as (
  select case cast(substr(source, 4) as int) % 4 when 0 then 'Marketing' when 1 then 'Sales'
              when 2 then 'Business' else 'Branding' end as sector,
         concat('doc_', cast(doc_id as varchar), '.pdf') as name, doc_id as ordinal, text
  from documents
)"""

_D = [t for _, t in _r.DESCRIPTION_RULES]

DESCRIBE_DOCUMENTS = f"""
with {_CORPUS},
named as (select sector, name, ordinal, lower(replace(name, '.pdf', '')) as stem from fx_corpus),
cache as (select name, text from fx_corpus where sector = 'Marketing')
select n.sector, n.name, n.ordinal, n.stem,
       case when cache.name is not null then cache.text
            when contains(n.stem, 'doc_1') or contains(n.stem, '99') then {_q(_D[0])}
            when contains(n.stem, '7') then {_q(_D[1])}
            when contains(n.stem, '33') or contains(n.stem, '44') then {_q(_D[2])}
            when contains(n.stem, '5') then {_q(_D[3])}
            when contains(n.stem, '2') then {_q(_D[4])}
            else {_q(_r.DESCRIPTION_DEFAULT)} end as description
from named n left join cache on n.name = cache.name"""

ORACLES.update({
    "text_cleaning": TEXT_CLEANING,
    "transcript_rules": TRANSCRIPT_RULES,
    "detect_sectors": DETECT_SECTORS,
    "describe_documents": DESCRIBE_DOCUMENTS,
})

# --- topics, corpus, stored meetings, outbox ----------------------------------------

MEETING_TOPICS = f"""
with {_TRANSCRIPTS},
w as (select conv_id, regexp_extract_all(lower(regexp_replace(text, '(?m)^[A-Za-z_]+: ', '', 'g')), '[\\p{{L}}\\p{{M}}]{{4,}}') as words
      from fx_transcripts),
u as (select conv_id, unnest(words) as word, unnest(range(len(words))) as wpos from w),
c as (select conv_id, word, count(*) as cnt, min(wpos) as first_at from u group by conv_id, word),
r as (select *, row_number() over (partition by conv_id order by cnt desc, first_at asc) as rk from c)
select conv_id, rk - 1 as pos, word as topic from r where rk <= 3"""

_NON_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_PARA = r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"
_TAG = r"(?s)<[^>]*>"

CORPUS_FROM_PAGES = f"""
with p as (
  select regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/$', '') as upath,
         regexp_replace(html, '{_NON_TEXT}', '', 'g') as body
  from pages
),
x as (
  select regexp_extract(upath, '^/([^/]+)', 1) as sector, 'pages' || upath as path,
         array_to_string(list_transform(regexp_extract_all(body, '{_PARA}', 1),
                                        lambda q: regexp_replace(q, '{_TAG}', '', 'g')), chr(10)) as prim,
         regexp_replace(body, '{_TAG}', ' ', 'g') as fb
  from p
),
y as (
  select sector, path, string_split_regex(path, '[/\\\\]')[-1] as name,
         case when coalesce(length({_strip('prim')}), 0) > 0 then prim else coalesce(fb, '') end as raw
  from x
),
c as (select sector, name, path, replace(replace({_strip('raw')}, chr(10), ' '), '  ', ' ') as text from y),
z as (select *, row_number() over (partition by sector, name order by path desc, text desc) as k from c)
select sector, name, path, text
from z where k = 1"""

_MEETINGS_JSON = _MEETINGS + """,
fx_meetings_json as (
  select m.meeting_id as id, cast(m.user_id as varchar) as sales_id, m.meeting_ts as meeting_ts,
         concat('{"topics":["t', cast(m.user_id % 7 as varchar), '","t', cast(m.user_id % 5 as varchar),
                '"],"fears":"f","objection":"', case when m.user_id % 3 = 0 then 'price' else '' end,
                '","summary":"Meeting of agent ', cast(m.user_id as varchar),
                ' held on a day whose first event came at ', m.meeting_id, '"}') as analysis_json,
         '[["guide.pdf","first words..."]]' as pdfs_json,
         concat('{"followup_1":{"subject":"s","body":"b"},"sales_scoring":', coalesce(s.j, '{}'), '}') as followup_json,
         coalesce(s.j, '{}') as scoring_json
  from fx_meetings m
  left join (
    select user_id, day, concat('{', concat_ws(',',
      '"click":' || cast(max(case when metric = 'click' then score end) as varchar),
      '"purchase":' || cast(max(case when metric = 'purchase' then score end) as varchar),
      '"signup":' || cast(max(case when metric = 'signup' then score end) as varchar),
      '"view":' || cast(max(case when metric = 'view' then score end) as varchar)
    ), '}') as j
    from fx_scores group by user_id, day
  ) s on m.user_id = s.user_id and m.day = s.day
)"""

ARCHIVE = f"""
with {_MEETINGS_JSON},
a as (select id, sales_id, {_ts('meeting_ts')} as meeting_date,
             row_number() over (order by meeting_ts desc, id desc, sales_id) as position,
             coalesce(json_extract_string(analysis_json, '$.summary'), '') as summary from fx_meetings_json),
b as (select *, case when length(summary) > 60 then substr(summary, 1, 60) || '...' else summary end as snip from a)
select id, sales_id, meeting_date, snip as summary_snippet,
       ' ' || meeting_date || ' | ' || ' ' || sales_id || ' | ' || ' ' || snip as label,
       'radar_' || md5(coalesce(id, meeting_date)) as chart_key, position
from b"""

DECODED_MEETINGS = f"""
with {_MEETINGS_JSON}
select id, sales_id, json_extract_string(analysis_json, '$.summary') as summary,
       nullif(json_extract_string(analysis_json, '$.objection'), '') as objection,
       cast(json_array_length(analysis_json, '$.topics') as bigint) as n_topics,
       json_extract_string(pdfs_json, '$[0][0]') as first_pdf,
       cast(len(list_filter(json_keys(followup_json), lambda k: starts_with(k, 'followup_'))) as bigint) as n_followups,
       cast(len(json_keys(scoring_json)) as bigint) as n_scores
from fx_meetings_json"""

TOPIC_ROWS = f"""
with {_MEETINGS_JSON},
t as (select id, sales_id, analysis_json, unnest(range(cast(json_array_length(analysis_json, '$.topics') as bigint))) as pos
      from fx_meetings_json)
select id, sales_id, cast(pos as bigint) as pos,
       json_extract_string(analysis_json, '$.topics[' || cast(pos as varchar) || ']') as topic
from t"""

FOLLOWUP_CARDS = f"""
with {_MEETINGS_JSON},
k as (select id, sales_id, followup_json, unnest(json_keys(followup_json)) as key from fx_meetings_json)
select id, sales_id, key,
       coalesce(json_extract_string(followup_json, '$."' || key || '".subject'), 'Follow-up Email') as subject,
       coalesce(json_extract_string(followup_json, '$."' || key || '".body'), '') as body
from k where starts_with(key, 'followup_')"""

SAVE_MEETINGS = f"""
with {_MEETINGS_JSON},
r as (select *, row_number() over (partition by id order by meeting_ts) as k from fx_meetings_json)
select id, sales_id, {_ts('meeting_ts')} as meeting_date from r
where k = 1 and id not in (select id from fx_meetings_json where meeting_ts < timestamp '2024-01-16')"""

_BOX = f"""
{_MEETINGS_JSON},
k as (select id as meeting_id, meeting_ts as reg, followup_json, unnest(json_keys(followup_json)) as key
      from fx_meetings_json),
box as (select meeting_id, key, reg, reg + interval 1 minute as send_at,
               json_extract(followup_json, '$."' || key || '"')::varchar as message
        from k where starts_with(key, 'followup_')),
firsts as (select *, case when date_trunc('day', reg) + (date_trunc('minute', send_at) - date_trunc('day', date_trunc('minute', send_at))) > reg
                          then date_trunc('day', reg) + (date_trunc('minute', send_at) - date_trunc('day', date_trunc('minute', send_at)))
                          else date_trunc('day', reg) + (date_trunc('minute', send_at) - date_trunc('day', date_trunc('minute', send_at))) + interval 1 day end as first_run
           from box)"""

OUTBOX = f"""
with {_BOX}
select meeting_id, key, message, strftime(send_at, '%Y-%m-%d %H:%M:%S') as send_at_text,
       strftime(send_at, '%H:%M') as slot
from box"""

DUE_MESSAGES = f"""
with {_BOX},
nowv as (select max(reg) as now from box),
occ as (select meeting_id, key, reg, unnest(generate_series(first_run, greatest((select now from nowv), first_run), interval 1 day)) as occurrence
        from firsts),
sent as (select meeting_id, key, first_run as occurrence from firsts where reg < timestamp '2024-01-10')
select o.meeting_id, o.key, {_ts('o.occurrence')} as occurrence
from occ o
where o.occurrence <= (select now from nowv)
  and not exists (select 1 from sent s where s.meeting_id = o.meeting_id and s.key = o.key and s.occurrence = o.occurrence)"""

ORACLES.update({
    "meeting_topics": MEETING_TOPICS,
    "corpus_from_pages": CORPUS_FROM_PAGES,
    "archive": ARCHIVE,
    "decoded_meetings": DECODED_MEETINGS,
    "topic_rows": TOPIC_ROWS,
    "followup_cards": FOLLOWUP_CARDS,
    "save_meetings": SAVE_MEETINGS,
    "outbox": OUTBOX,
    "due_messages": DUE_MESSAGES,
})


def _listed_sql(field: str, empty: str, out: str) -> str:
    return f"""
with {_MEETINGS_JSON},
l as (select id, sales_id,
             coalesce(from_json(json_extract(followup_json, '$.{field}'), '["VARCHAR"]'), []) as items
      from fx_meetings_json),
d as (select id, sales_id, case when len(items) > 0 then items else ['{empty}'] end as items from l)
select id, sales_id, unnest(range(len(items))) as pos, unnest(items) as {out} from d"""


ORACLES.update({
    "mistake_rows": _listed_sql("wrong_chat_or_action", "No mistakes detected.", "mistake"),
    "missed_rows": _listed_sql("missed_important_service", "No missed opportunities.", "missed"),
})


REPORT_HEADERS = f"""
with {_MEETINGS_JSON},
m as (select *, list_sort(list_filter(json_keys(followup_json), lambda x: starts_with(x, 'followup_'))) as fkeys
      from fx_meetings_json)
select id, sales_id, {_ts('meeting_ts')} as meeting_date,
       coalesce(json_extract_string(analysis_json, '$.summary'), 'No summary available.') as summary,
       nullif(json_extract_string(analysis_json, '$.objection'), '') as objection,
       cast(coalesce(json_array_length(analysis_json, '$.topics'), 0) as bigint) as n_topics,
       cast(len(fkeys) as bigint) as n_followups,
       coalesce(json_extract_string(followup_json, '$."' || fkeys[1] || '".subject'), 'Follow-up Email')
         as first_subject,
       cast(len(json_keys(scoring_json)) as bigint) as n_scores,
       'radar_' || md5(id) as chart_key
from m"""

ORACLES["report_headers"] = REPORT_HEADERS


# --- ordering, open metric sets, stamps ---------------------------------------------

ORACLES["score_maps"] = f"""
with {_MEETINGS},
v as (select sales_id, meeting_id, metric, max(cast(score as double)) as value from scored group by all)
select sales_id, meeting_id, string_agg(metric || '=' || cast(value as varchar), ',' order by metric) as scores_text
from v group by sales_id, meeting_id"""

ORACLES["meetings_by_date"] = f"""
with {_MEETINGS_JSON}
select id, sales_id, row_number() over (order by meeting_ts desc, id desc, sales_id) as position from fx_meetings_json"""

ORACLES["stamped_meetings"] = f"""
with {_MEETINGS_JSON}
select id, sales_id,
       strftime(meeting_ts, '%Y-%m-%dT%H:%M:%S')
         || case when microsecond(meeting_ts) % 1000000 <> 0 then '.' || lpad(cast(microsecond(meeting_ts) % 1000000 as varchar), 6, '0')
                 else '' end as meeting_date,
       scoring_json as scoring
from fx_meetings_json"""

# --- the odd forms of stored JSON: expected results written case by case --------------

_VARIED = _MEETINGS + """,
v as (select meeting_id as id, cast(user_id as varchar) as sales_id, meeting_ts, user_id as u, day(day) as d,
             user_id % 11 = 0 and day(day) % 2 = 1 as cut_off from fx_meetings),
cards as (
  select id, sales_id, 'followup_1' as key, case when u % 6 = 0 then 'last' else 's' || u end as subject,
         case when u % 6 = 0 then 'wins' else 'b' || d end as body, '' as files from v where not cut_off
  union all select id, sales_id, 'followup_2', 'Follow-up Email', 'only body',
         'a' || u || '.pdf:d' || d || ',file.pdf:no name' from v where not cut_off and d % 2 = 0
  union all select id, sales_id, 'followup_10', 'Follow-up Email', 'plain ' || u, '' from v where not cut_off and d % 3 = 0),
mistakes as (select id, sales_id, case u % 5 when 2 then ['late ' || u, 'rude'] when 3 then ['He was rude ' || d]
                                  else ['No mistakes detected.'] end as items from v where not cut_off),
missed as (select id, sales_id, case u % 4 when 1 then ['service ' || d] when 2 then ['one text']
                                else ['No missed opportunities.'] end as items from v where not cut_off),
scoring as (select id, '{"clarity":7.5,"rapport":" 8 ","tone":' || case u % 7 when 0 then '"bad"' when 1 then '1e30' when 2 then 'true'
                       when 3 then '"inf"' else d || '.12499996' end || case when u % 6 = 0 then ',"clarity":' || d else '' end || '}' as j,
                   sales_id from v)"""

ORACLES["varied_cards"] = f"""
with {_VARIED}
select id, sales_id, key, subject, body, row_number() over (partition by id, sales_id order by key) as position from cards"""

_REASON = _q("This PDF reinforces the topic <b></b> \n                                    and helps the client fully understand the solution.")

ORACLES["varied_attachments"] = f"""
with {_VARIED}
select id, sales_id, 'followup_2' as key, cast(0 as bigint) as pos, 'a' || u || '.pdf' as name, 'd' || d as description, {_REASON} as reason
from v where not cut_off and d % 2 = 0
union all
select id, sales_id, 'followup_2', 1, 'file.pdf', 'no name', {_REASON} from v where not cut_off and d % 2 = 0"""

ORACLES["varied_mistakes"] = f"""
with {_VARIED}
select id, sales_id, unnest(range(len(items))) as pos, unnest(items) as mistake from mistakes"""

ORACLES["varied_missed"] = f"""
with {_VARIED}
select id, sales_id, unnest(range(len(items))) as pos, unnest(items) as missed from missed"""

ORACLES["varied_rejects"] = f"""
with {_VARIED}
select v.id, '{{"topics":["t' || u % 7 || '"],"objection":"' || case when u % 3 = 0 then 'price' else '' end || '"'
       || case when d % 5 = 0 then '' else ',"summary":"Meeting ' || u || '"' end || '}}' as analysis_json, j as scoring_json
from v join scoring on v.id = scoring.id and v.sales_id = scoring.sales_id where cut_off"""

ORACLES["varied_reports"] = f"""
with {_VARIED},
f as (select id, sales_id, string_agg(key || '=' || subject || '/' || body || '/' || files, ';' order by key) as followups
      from cards group by id, sales_id)
select v.id, v.sales_id, {_ts('meeting_ts')} as meeting_date,
       case when d % 5 = 0 then 'No summary available.' else 'Meeting ' || u end as summary,
       case when u % 3 = 0 then 'price' end as objection, 't' || u % 7 as topics,
       array_to_string(mistakes.items, '|') as mistakes, array_to_string(missed.items, '|') as missed, followups,
       cast(3 as bigint) as n_scores
from v join f on v.id = f.id and v.sales_id = f.sales_id
join mistakes on v.id = mistakes.id and v.sales_id = mistakes.sales_id
join missed on v.id = missed.id and v.sales_id = missed.sales_id"""

ORACLES["varied_means"] = f"""
with {_VARIED},
s as (select 'clarity' as metric, case when u % 6 = 0 then d * 100000000 else 750000000 end as units from v
      union all select 'rapport', 800000000 from v
      union all select 'tone', case when u % 7 = 2 then 100000000 else d * 100000000 + 12499996 end from v where u % 7 in (2, 4, 5, 6))
select metric, {_label('metric')} as metric_label, {_round2('sum(units)', '(count(*) * 100000000)')} as avg_score,
       count(*) as n_scores
from s group by metric"""

ORACLES["score_rejects"] = f"""
with {_VARIED}
select id, sales_id, cast(2 as bigint) as pos, 'tone' as metric,
       case u % 7 when 0 then 'not a number' when 1 then 'out of range' else 'not finite' end as reason
from v where u % 7 in (0, 1, 3)"""

# --- model path ------------------------------------------------------------------------

ORACLES["model_replies"] = f"""
with {_TRANSCRIPTS},
g as (select conv_id, text, length(text) % 4 as kind, cast(to_json({{'topics': ['a', 'b'], 'fears': 'f', 'objection': 'o',
             'summary': substr(text, 1, 30), 'clarity': 'kept'}}) as varchar) as good from fx_transcripts)
select conv_id, case kind when 1 then 'not a JSON object' when 2 then 'missing field: fears' when 3 then 'not a JSON object' end as reason,
       case when kind = 0 then substr(text, 1, 30) end as summary, case when kind = 0 then 'a,b' end as topics,
       case kind when 0 then good when 1 then left(good, length(good) - 9) when 2 then replace(good, '"fears":"f",', '')
            else 'text: ' || text end as reply
from g"""


_PICKS = """
ids as (select distinct conv_id from conversations),
picks as (select conv_id, row_number() over (partition by conv_id order by coalesce(length(text), 0), ordinal) as rank, ordinal
          from ids join fx_corpus on conv_id % (select count(*) from ids) = ordinal * 7919 % (select count(*) from ids)
          qualify rank <= 2)"""

_BLOCKS = f"""
select conv_id, string_agg(name || ': ' || array_to_string(string_split({_clean('text')}, ' ')[1:40], ' ') || '...', chr(10) order by rank)
         as document_block
from picks join fx_corpus using (ordinal) group by conv_id"""

ORACLES["document_blocks"] = f"with {_CORPUS}, {_PICKS} {_BLOCKS}"


def _plan_sql(variant: str) -> str:
    from parley.operators import inference as _i
    text = _q(_i.PLAN_SYSTEM[variant] + _i.PLAN_USER)
    listed = "coalesce(array_to_string(list_transform(topics, lambda t: chr(39) || t || chr(39) || ', '), ''), '')"
    shown = {
        "summary": "summary", "objection": "objection",
        "topics": "case when contains(text, 'nicht') then '[]' else '[' || " + listed + r" || chr(34) || 'it''s' || chr(34) || ', ''a\\b'']' end",
        "fears": "case when contains(text, 'sch') then 'None' else 'fear ' || substr(text, 1, 20) end",
        "documents": "case when length(text) % 2 = 0 then coalesce(document_block, '') else '' end"}
    for name, value in shown.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return f"""
with {_TRANSCRIPTS}, {_CORPUS}, {_PICKS},
listed as (select conv_id, list(topic order by pos) as topics from ({MEETING_TOPICS}) group by conv_id),
ruled as (select conv_id, objection from ({TRANSCRIPT_RULES})),
said as (select conv_id, text, array_to_string(string_split({_clean('text')}, ' ')[1:40], ' ') || '...' as summary from fx_transcripts)
select conv_id, {text} as prompt, '{variant}' as variant
from said left join listed using (conv_id) left join ruled using (conv_id) left join ({_BLOCKS}) using (conv_id)"""


ORACLES["plan_requests"] = f"({_plan_sql('plan')}) union all ({_plan_sql('sending')})"


def _message(step: int) -> str:
    text = _q(_r.MESSAGE_1 if step == 1 else _r.MESSAGE_2)
    for name, value in (("client_name", "client_name"), ("topic", "topic_phrase"),
                        (f"pdf{step}", f"coalesce(name{step}, 'None')"), (f"desc{step}", f"coalesce(desc{step}, '')")):
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


ORACLES["followup_records"] = TRANSCRIPT_RULES.replace("with ", f"with {_CORPUS}, {_PICKS}, ", 1).rsplit("select conv_id, client_name", 1)[0] + f"""
, p as (select conv_id, max(case when rank = 1 then name end) as name1, max(case when rank = 2 then name end) as name2,
               max(case when rank = 1 then sector end) as desc1, max(case when rank = 2 then sector end) as desc2
        from picks join fx_corpus using (ordinal) group by conv_id)
select c.conv_id, client_name, objection, name1 as selected_pdf_1, name2 as selected_pdf_2,
       coalesce(desc1, '') as pdf1_description, coalesce(desc2, '') as pdf2_description,
       {_message(1)} as followup_1, {_message(2)} as followup_2, {_M3} as followup_3,
       {_fill1(_r.MESSAGE_4, 'client_name')} as followup_4,
       '{{' || '{",".join(f'"{k}":"{v}"' for k, v in _r.SCHEDULE)}' || '}}' as schedule
from c left join p on c.conv_id = p.conv_id"""


ORACLES["due_messages_since"] = f"""
with {_BOX},
nowv as (select max(reg) as now from box),
occ as (select meeting_id, key, unnest(generate_series(first_run, greatest((select now from nowv), first_run), interval 1 day)) as occurrence
        from firsts)
select meeting_id, key, {_ts('occurrence')} as occurrence
from occ where occurrence <= (select now from nowv) and occurrence > timestamp '2024-01-20 00:00:00'"""


ORACLES["detect_sectors_lexicon"] = f"""
with {_TRANSCRIPTS},
lex as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as keyword from benchmark)
select distinct conv_id, substr(keyword, 1, 1) as sector
from fx_transcripts join lex on contains(lower(text), keyword)"""

ORACLES["agent_state_scores"] = WEIGHTED_SCORES

ORACLES["streamed_deliveries"] = f"""
with {_BOX},
one as (select meeting_id, key, min(reg) as reg, min(message) as message from box group by meeting_id, key),
due as (select distinct o.meeting_id, o.key, o.message, f.first_run
        from one o join firsts f on o.meeting_id = f.meeting_id and o.key = f.key and o.reg = f.reg),
nowv as (select max(reg) as now from one),
occ as (select meeting_id, key, message,
               unnest(generate_series(first_run, greatest((select now from nowv), first_run), interval 1 day)) as occurrence from due)
select meeting_id, key, message, {_ts('occurrence')} as occurrence from occ where occurrence <= (select greatest(now, timestamp '2024-01-23 12:00:00') from nowv)"""

ORACLES["archive_page"] = f"select * from ({ARCHIVE}) where position between 201 and 300"
