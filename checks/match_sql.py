"""DuckDB SQL for the rankers and what is built on them.

The Ratcliff/Obershelp ratio is written as a recursive query: every step takes
a pair of text parts, lists all blocks of the shorter text with their first
place in the longer one, keeps the longest (then the one that starts first),
and goes on with the parts before and behind it. It scores every pair of a
transcript and a file of its sectors, and every pair of a topic and a head of
fewer than 200 characters; that no longer head can reach the two best is
checked by its length, and the query fails if one could."""

from __future__ import annotations

from checks.oracle_sql import (_CORPUS, _M3, _TRANSCRIPTS, DESCRIBE_DOCUMENTS, DETECT_SECTORS, MEETING_TOPICS, ORACLES, TRANSCRIPT_RULES, _clean,
                               _fill1, _message, _q, _r)


def _block(first: str, second: str, short_first: bool) -> str:
    """{n: -length, i, j}: the block of two texts that counts, n = 0 for none."""
    short, long = (first, second) if short_first else (second, first)
    at, other = ("i", "j") if short_first else ("j", "i")
    found = f"strpos({long}, substr({short}, s, n))"
    row = f"{{'n': case when {found} > 0 then -n else 0 end, 'i': {'s' if at == 'i' else found}, 'j': {'s' if at == 'j' else found}}}"
    return (f"list_min(list_prepend({{'n': 0, 'i': 0, 'j': 0}}, flatten([[{row} for s in range(1, length({short}) - n + 2)] "
            f"for n in range(1, length({short}) + 1)])))")


def _matched(pairs: str, short_first: bool) -> str:
    """CTEs that give ``matched(a, b, m)`` for the rows (a, b) of ``pairs``."""
    return f"""
parts as (
  select a, b, a as x, b as y, {_block('a', 'b', short_first)} as blk from {pairs}
  union all
  select a, b, p.x, p.y, {_block('p.x', 'p.y', short_first)} from (
    select a, b, unnest([{{'x': substr(x, 1, blk.i - 1), 'y': substr(y, 1, blk.j - 1)}},
                         {{'x': substr(x, blk.i - blk.n), 'y': substr(y, blk.j - blk.n)}}]) as p
    from parts where blk.n < 0)
  where length(p.x) > 0 and length(p.y) > 0
),
matched as (select a, b, cast(-sum(blk.n) as bigint) as m from parts group by a, b)"""


def _inner(sql: str) -> str:
    """A query as a subquery whose CTEs keep to themselves."""
    return f"({sql})"


_NAME_PICKS = f"""
pair as (select s.conv_id, f.sector, f.name, lower(t.text) as a, lower(f.name) as b
         from {_inner(DETECT_SECTORS)} s join fx_transcripts t using (conv_id) join fx_corpus f using (sector)),
ab as (select distinct a, b from pair),{_matched('ab', False)},
name_scores as (select conv_id, sector, name, case when a = '' or b = '' then 0
                       else cast(round_even(100 * (2.0::double * m / (length(a) + length(b))), 0) as int) end as score
                from pair join matched using (a, b)),
name_picks as (select conv_id, cast(row_number() over (partition by conv_id order by score desc, name, sector) as int) as rank, sector, name, score
               from name_scores qualify rank <= 2)"""

RANK_BY_NAME = f"""
with recursive {_TRANSCRIPTS}, {_CORPUS}, {_NAME_PICKS}
select conv_id, rank, sector, name, score from name_picks"""

_TOPIC_PICKS = f"""
topics as (select conv_id, pos, lower(topic) as a from {_inner(MEETING_TOPICS)}),
heads as (select ordinal, name, text, lower({_clean('substr(text, 1, 2000)')}) as b from fx_corpus),
ab as (select distinct a, b from topics, heads where length(b) < 200),{_matched('ab', True)},
ratios as (select a, b, case when length(a) + length(b) = 0 then 1.0::double else 2.0::double * m / (length(a) + length(b)) end * 100.0::double as r
           from matched),
topic_scores as (select conv_id, ordinal, list_reduce(list_prepend(0.0::double, list(r order by pos)), lambda x, y: x + y) / count(*) as score
                 from topics join ratios using (a) join heads using (b) group by conv_id, ordinal),
longer as (select conv_id, avg(200.0::double * least(length(a), 200) / (length(a) + 200)) as bound from topics group by conv_id),
topic_ranks as (select conv_id, row_number() over (partition by conv_id order by score desc, ordinal) as place, ordinal, score
                from topic_scores qualify place <= 2),
topic_picks as (select conv_id, cast(place as int) as rank, ordinal,
                       case when score > bound + 1e-9 then score else error('a longer head could rank') end as score
                from topic_ranks join longer using (conv_id))"""

_SUMMARY = "array_to_string(string_split({text}, ' ')[1:40], ' ') || '...'"

MATCH_DOCUMENTS = f"""
with recursive {_CORPUS}, {_TOPIC_PICKS}
select conv_id, rank, name, ordinal, score, {_SUMMARY.format(text=_clean('text'))} as summary
from topic_picks join heads using (ordinal)"""


def _plan_prompts() -> str:
    from parley.operators import inference as _i
    text = _q(_i.PLAN_SYSTEM["plan"] + _i.PLAN_USER)
    listed = "array_to_string(list_transform(topics, lambda t: '''' || t || ''''), ', ')"
    shown = {"summary": "summary", "objection": "objection", "fears": "''", "topics": f"'[' || coalesce({listed}, '') || ']'",
             "documents": "coalesce(document_block, '')"}
    for name, value in shown.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return f"""
with recursive {_TRANSCRIPTS}, {_CORPUS}, {_TOPIC_PICKS},
blocks as (select conv_id, string_agg(name || ': ' || {_SUMMARY.format(text=_clean('text'))}, chr(10) order by rank) as document_block
           from topic_picks join heads using (ordinal) group by conv_id),
listed as (select conv_id, list(a order by pos) as topics from topics group by conv_id),
ruled as (select conv_id, objection from {_inner(TRANSCRIPT_RULES)}),
said as (select conv_id, {_SUMMARY.format(text=_clean('text'))} as summary from fx_transcripts)
select conv_id, {text} as prompt
from said left join listed using (conv_id) left join blocks using (conv_id) left join ruled using (conv_id)"""


_RULED = TRANSCRIPT_RULES.replace("with ", "", 1).rsplit("select conv_id, client_name", 1)[0].split(_TRANSCRIPTS + ",", 1)[1]

RULE_FOLLOWUPS = f"""
with recursive {_TRANSCRIPTS}, {_CORPUS}, {_NAME_PICKS}, {_RULED},
described as (select sector, name, description from {_inner(DESCRIBE_DOCUMENTS)}),
p as (select conv_id, max(case when rank = 1 then name end) as name1, max(case when rank = 2 then name end) as name2,
             max(case when rank = 1 then description end) as desc1, max(case when rank = 2 then description end) as desc2
      from name_picks join described using (sector, name) group by conv_id)
select c.conv_id, client_name, objection, name1 as selected_pdf_1, name2 as selected_pdf_2,
       coalesce(desc1, '') as pdf1_description, coalesce(desc2, '') as pdf2_description,
       {_message(1)} as followup_1, {_message(2)} as followup_2, {_M3} as followup_3,
       {_fill1(_r.MESSAGE_4, 'client_name')} as followup_4,
       '{{' || '{",".join(f'"{k}":"{v}"' for k, v in _r.SCHEDULE)}' || '}}' as schedule
from c left join p on c.conv_id = p.conv_id"""

ORACLES.update({"rank_by_name": RANK_BY_NAME, "match_documents": MATCH_DOCUMENTS, "plan_prompts": _plan_prompts(), "rule_followups": RULE_FOLLOWUPS})
