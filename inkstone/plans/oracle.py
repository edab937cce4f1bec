"""DuckDB SQL for the registered queries.

It follows another road than the Spark side: line tables with windows in place of arrays inside the row, and character
positions in place of look-arounds, which RE2 lacks.
"""

from __future__ import annotations

from inkstone.plans import oracle_values as v
from inkstone.plans.dressing import dressed_sql
from inkstone.plans.oracle_values import BREAK, BULLET, COUNTED_WORD, FENCE_LINE, FIRST_WORD, LINE_END, WORD, WS, note, results


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{WS}]+')}, '')"


def excerpt(x: str, start0: str, lead: int) -> str:
    s = f"greatest(0, {start0} - {lead})"
    cut = strip(f"substr({x}, {s} + 1, least(length({x}), {s} + 120) - {s})")
    return f"(case when {s} > 0 then '…' else '' end || {cut} || case when {s} + 120 < length({x}) then '…' else '' end)"


def sentences(x: str) -> str:
    pattern = lit(rf"([.!?])[{WS}]+([A-Z\"'(\[])")
    return rf"string_split(regexp_replace({x}, {pattern}, '\1' || chr(1) || '\2', 'g'), chr(1))"


def _free(col: str) -> str:
    return f"length(regexp_replace(substr(line, 1, {col}), '[^`]', '', 'g')) % 2 = 0"


JARGON = "|".join(sorted(v.JARGON, key=len, reverse=True))
CLICHES = ", ".join(f"({i}, {lit(p)})" for i, p in enumerate(v.CLICHES))
RESULTS = ", ".join(
    f"({place}, {lit(rule)}, {lit(severity)}, {lit(kind)}, {lit(note(rule, kind, False))}, {lit(note(rule, kind, True))})" for place, rule, severity, kind in results()
)
BOUND = f"[^{WORD}]"


def prelude(source: str = f"select doc_id, {dressed_sql()} as text, lang, source from documents") -> str:
    """Common table expressions from texts to violations ``v`` (doc_id, rule, ord, seq, line, col, excerpt, detail)."""
    tokens = lit(v.TITLE_TOKEN)
    lower = ", ".join(lit(w) for w in v.LOWER_IN_TITLES)
    upper = lambda x: f"regexp_matches({x}, '^[A-Z0-9]')"
    heading_text = rf"regexp_replace(regexp_replace({strip(f'regexp_extract(line, {lit(v.HEADING)}, 1)')}, '`[^`]*`', '', 'g'), '\[([^\]]*)\]\([^\)]*\)', '\1', 'g')"
    openers = " ".join(f"when word = {lit(o.lower())} then {lit(o)}" for o in v.OPENERS)
    summaries = v.SUMMARIES
    closers = v.CLOSERS
    return f"""
with docs as ({source}),
lines0 as (
  select doc_id, unnest(string_split(regexp_replace(text, {lit(LINE_END)}, chr(10), 'g'), chr(10))) as line,
         generate_subscripts(string_split(regexp_replace(text, {lit(LINE_END)}, chr(10), 'g'), chr(10)), 1) as n
  from docs where text <> ''
),
lines as (
  select doc_id, n, line, regexp_matches(line, {lit(FENCE_LINE)}) as marker,
         sum(regexp_matches(line, {lit(FENCE_LINE)})::int) over (partition by doc_id order by n) % 2 = 1 as hidden
  from (select *, max(n) over (partition by doc_id) as last from lines0) where n < last or line <> ''
),
fences as (select doc_id, n, line, hidden, hidden or marker as fenced from lines),
open as (select doc_id, n, line from fences where not hidden),
places as (
  select doc_id, n, line, unnest(range(1, length(line) + 1)) as c
  from open where regexp_matches(line, '[—–'']') or regexp_matches(lower(line), '{JARGON}') or regexp_matches(lower(line), {lit("|".join(v.CLICHES))})
),
dash as (
  select doc_id, n, c, line, case when substr(line, c, 1) = '—' then 'em' else 'en' end as kind
  from places
  where (substr(line, c, 1) = '—' or (substr(line, c, 1) = '–' and not (c > 1 and regexp_matches(substr(line, c - 1, 1), '\\p{{Nd}}') and regexp_matches(substr(line, c + 1, 1), '\\p{{Nd}}'))))
    and {_free("c")}
),
apostrophe as (
  select doc_id, n, line, c,
         regexp_extract(substr(line, 1, c - 1), '(^|{BOUND})([A-Za-z]+)$', 2) as l,
         regexp_extract(substr(line, c + 1), '^((?i:{v.CONTRACTION_ENDS}))({BOUND}|$)', 1) as r
  from places where substr(line, c, 1) = ''''
),
contraction as (select doc_id, n, line, c - length(l) as c, l || '''' || r as m from apostrophe where l <> '' and r <> '' and {_free("c - length(l)")}),
jargon as (
  select doc_id, n, line, c, regexp_extract(substr(line, c), '^((?i:{JARGON}))({BOUND}|$)', 1) as m
  from places where regexp_matches(lower(line), '{JARGON}') and (c = 1 or regexp_matches(substr(line, c - 1, 1), '{BOUND}')) and {_free("c")}
),
phrases(ord, phrase) as (values {CLICHES}),
cliche as (
  select doc_id, n, line, c, ord, phrase from places join phrases on substr(lower(line), c, length(phrase)) = phrase
  where regexp_matches(lower(line), {lit("|".join(v.CLICHES))}) and {_free("c")}
),
opener as (
  select doc_id, n, line, length(line) - length(after) + 1 as c,
         case {openers} when word = 'in' and lower(after) like 'in addition%' then 'In addition' end as m
  from (select *, lower(regexp_extract(after, '^[A-Za-z][A-Za-z-]*')) as word
        from (select *, regexp_replace({lstrip("line")}, {lit(v.MARKUP)}, '') as after from open))
),
heading as (
  select doc_id, n, line,
         list_filter(t, lambda x, i: case when x like '%-%' then len(list_filter(string_split(x, '-'), lambda p: p <> '' and not {upper("p")})) > 0
                                          when i = 1 or i = len(t) then not {upper("x")}
                                          when lower(x) in ({lower}) then x <> lower(x) else not {upper("x")} end) as bad
  from (select *, regexp_extract_all({heading_text}, {tokens}) as t from open where regexp_matches(line, {lit(v.HEADING)}))
),
line_sentences as (
  select doc_id, n, unnest({sentences(strip("line"))}) as s, generate_subscripts({sentences(strip("line"))}, 1) as k
  from open where not regexp_matches(line, {lit(f"^[{WS}]*(?:[#|]|$)")})
),
counted as (select *, len(regexp_extract_all(s, {lit(COUNTED_WORD)})) as words from line_sentences),
breaks as (select *, fenced or regexp_matches(line, {lit(BREAK)}) as gap from fences),
para_lines as (select *, sum(gap::int) over (partition by doc_id order by n) as p from breaks),
paras as (
  select doc_id, p, min(n) as start, count(*) as n_lines, string_agg({strip("line")}, ' ' order by n) as joined
  from para_lines where not gap group by doc_id, p
),
para_sentences0 as (
  select doc_id, p, start, n_lines, {strip("s")} as s, k
  from (select *, unnest({sentences("joined")}) as s, generate_subscripts({sentences("joined")}, 1) as k from paras)
),
para_sentences as (
  select doc_id, p, start, n_lines, s, row_number() over (partition by doc_id, p order by k) as k, lower(regexp_extract({lstrip("s")}, {lit(FIRST_WORD)})) as f
  from para_sentences0 where s <> ''
),
looked as (
  select *, lead(f, 1) over w as f1, lead(f, 2) over w as f2, count(*) over (partition by doc_id, p) as total
  from para_sentences window w as (partition by doc_id, p order by k)
),
alike as (
  select *, case when f <> '' and (f = f1 or f = f2) then f when f1 <> '' and f1 = f2 then f1 end as w from looked where k < total
),
same as (select doc_id, p, start, arg_min(s, k) as s, arg_min(w, k) as w from alike where w is not null group by doc_id, p, start),
closer as (
  select * from looked where k = total and (regexp_matches(s, '(?i)^(?:{closers})') or regexp_matches(s, '(?i)(?:^|{BOUND})(?:{summaries})(?:{BOUND}|$)'))
),
bullets as (
  select doc_id, n, line, len(regexp_extract_all(regexp_extract(line, {lit(BULLET)}, 1), {lit(f"[^{WS}]+")})) as tokens,
         n - row_number() over (partition by doc_id order by n) as island
  from fences where not fenced and regexp_matches(line, {lit(BULLET)})
),
lists as (select doc_id, min(n) as start, arg_min(line, n) as line, count(*) as items, max(tokens) as most from bullets group by doc_id, island),
v0 as (
  select doc_id, 'RULE-B' as rule, 0 as ord, 0 as seq, n as line, c as col, {excerpt("line", "c - 1", 20)} as excerpt, kind || '-dash as casual punctuation' as detail from dash
  union all select doc_id, 'RULE-I', 0, 0, n, c, {excerpt("line", "c - 1", 20)}, 'contraction ''' || m || '''' from contraction
  union all select doc_id, 'RULE-06', 0, 0, n, c, {excerpt("line", "c - 1", 20)}, 'jargon / AI-tell ''' || m || '''' from jargon where m <> ''
  union all select doc_id, 'RULE-05', ord, 0, n, c, {excerpt("line", "c - 1", 20)}, 'cliché phrase ''' || phrase || '''' from cliche
  union all select doc_id, 'RULE-D', 0, 0, n, c, {excerpt("line", "c - 1", 20)}, 'transition opener ''' || m || '''' from opener where m is not null
  union all select doc_id, 'RULE-G', 0, 0, n, 1, {excerpt("line", "0", 20)}, 'heading not in title case; violating tokens: ' || array_to_string(bad, ', ') from heading where len(bad) > 0
  union all select doc_id, 'RULE-12', 0, k, n, 1, {excerpt("s", "0", 20)}, 'sentence length ' || words || ' words (>30)' from counted where words > 30
  union all select doc_id, 'RULE-C', 0, 0, start, 1, {excerpt("s", "0", 10)}, 'consecutive sentences start with ''' || w || '''' from same
  union all select doc_id, 'RULE-E', 0, 0, start + n_lines - 1, 1, {excerpt("s", "0", 10)}, 'paragraph ends with a summary / restatement' from closer
  union all select doc_id, 'RULE-A', 0, 0, start, 1, {excerpt("line", "0", 10)},
         case when items <= 2 then 'list has only ' || items || ' item(s); consider prose' else 'list has ' || items || ' items all ≤ 8 words; consider prose' end
       from lists where items <= 2 or most <= 8
),
v as (select doc_id, rule, ord, seq, line::int as line, col::int as col, excerpt, detail from v0),
catalogue(place, rule, severity, detector, note, note_mech) as (values {RESULTS}),
counts as (select doc_id, rule, count(*) as n from v group by doc_id, rule),
audit as (
  select doc_id, place, c.rule, severity, detector,
         case when note <> '' then 'skipped' when coalesce(n, 0) > 0 then 'violation' else 'ok' end as status,
         case when note <> '' then 0 else coalesce(n, 0) end::int as count, note
  from docs cross join catalogue c left join counts using (doc_id, rule)
),
mech as (
  select doc_id, place, c.rule, severity, detector,
         case when note_mech <> '' then 'skipped' when coalesce(n, 0) > 0 then 'violation' else 'ok' end as status,
         case when note_mech <> '' then 0 else coalesce(n, 0) end::int as count, note_mech as note
  from docs cross join catalogue c left join counts using (doc_id, rule)
)
"""


#: Drafts: dressed texts are the baseline of a source's task, the plain texts its treatment; a language is a runner.
DRAFTS = f"""
select doc_id * 2 as doc_id, {dressed_sql()} as text, lang as runner, source as task, doc_id % 2 + 1 as generation, 'baseline' as condition from documents
union all select doc_id * 2 + 1, coalesce(text, ''), lang, source, doc_id % 2 + 1, 'treatment' from documents
"""
SCORES = """,
each as (select runner, task, generation, condition, rule, sum(count) as n from mech join docs using (doc_id) group by all),
task_sums as (
  select runner, task, coalesce(sum(n) filter (condition = 'baseline'), 0)::bigint as baseline, coalesce(sum(n) filter (condition = 'treatment'), 0)::bigint as treatment
  from each group by runner, task
),
gen1 as (
  select runner, task, rule, coalesce(sum(n) filter (condition = 'treatment'), 0) - coalesce(sum(n) filter (condition = 'baseline'), 0) as delta
  from each where generation = 1 group by runner, task, rule
),
dominant as (select runner, task, first(rule order by delta, rule) as dominant from gen1 where delta <> 0 group by runner, task),
rule_sums as (
  select runner, rule, coalesce(sum(n) filter (condition = 'baseline'), 0)::bigint as baseline, coalesce(sum(n) filter (condition = 'treatment'), 0)::bigint as treatment
  from each group by runner, rule having sum(n) > 0
),
totals as (select runner, sum(baseline)::bigint as baseline, sum(treatment)::bigint as treatment from task_sums group by runner)
"""
