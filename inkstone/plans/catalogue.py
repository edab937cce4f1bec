"""Registered queries of the prose engine and their SQL oracles."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import canon
from inkstone.functions.chars import LINE_END, WS, excerpt, split_lines, split_sentences, strip, token_count, word_count
from inkstone.operators import audit as au
from inkstone.operators import scorecard as sc
from inkstone.operators.detectors import all_detectors
from inkstone.operators.structure import lines_of, with_structure
from inkstone.plans import registers, releases
from inkstone.plans.dressing import dressed, dressed_sql
from inkstone.plans.oracle import COUNTED_WORD, DRAFTS, SCORES, lit, prelude, sentences
from inkstone.plans.oracle import excerpt as excerpt_sql
from inkstone.plans.oracle import strip as strip_sql
from inkstone.runtime import ensure_checkpoint_dir, table
from inkstone.sources import benchmark, documents, registry, rulepack

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[name] = query
        _ORACLES[name] = sql
        return query

    return add


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dressed(_raw(spark, sf_dir))


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("runner"), F.col("source").alias("task"), (F.col("doc_id") % 2 + 1).alias("generation"))
    return dressed(raw).withColumn("condition", F.lit("baseline")).unionByName(raw.withColumn("condition", F.lit("treatment")))


_RAW = "select doc_id, coalesce(text, '') as text, lang, source from documents"


# Lines, sentences, words.


@_register(
    "lines_stats",
    f"""select doc_id, count(*) filter (n < last or line <> '') as n_lines, count(*) filter ({strip_sql("line")} = '' and (n < last or line <> '')) as n_blank,
    coalesce(max(length(line)), 0)::bigint as longest
    from (select *, max(n) over (partition by doc_id) as last from (
      select doc_id, unnest(string_split(regexp_replace({dressed_sql()}, {lit(LINE_END)}, chr(10), 'g'), chr(10))) as line,
             generate_subscripts(string_split(regexp_replace({dressed_sql()}, {lit(LINE_END)}, chr(10), 'g'), chr(10)), 1) as n from documents))
    group by doc_id""",
)
def lines_stats(spark, sf_dir):
    lines = _dressed(spark, sf_dir).select("doc_id", split_lines(F.col("text")).alias("lines"))
    blank = F.size(F.filter("lines", lambda x: strip(x) == ""))
    longest = F.coalesce(F.array_max(F.transform("lines", lambda x: F.length(x))), F.lit(0))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), blank.cast("long").alias("n_blank"), longest.cast("long").alias("longest"))


_SENTENCE_ROWS = f"""(select doc_id, lang, n, k, s, len(regexp_extract_all(s, {lit(COUNTED_WORD)})) as words, len(regexp_extract_all(s, {lit(f"[^{WS}]+")})) as tokens from (
  select doc_id, lang, n, unnest({sentences(strip_sql("line"))}) as s, generate_subscripts({sentences(strip_sql("line"))}, 1) as k from (
    select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)) where s <> '')"""


def _sentence_rows(spark, sf_dir):
    lines = _raw(spark, sf_dir).select("doc_id", "lang", F.posexplode(split_lines(F.col("text"))).alias("n", "line"))
    rows = lines.select("doc_id", "lang", (F.col("n") + 1).alias("n"), F.posexplode(split_sentences(strip(F.col("line")))).alias("k", "s")).where("s <> ''")
    return rows.select("doc_id", "lang", "n", (F.col("k") + 1).alias("k"), "s", word_count(F.col("s")).alias("words"), token_count(F.col("s")).alias("tokens"))


@_register("sentence_words", f"select doc_id, count(*) as sentences, sum(words)::bigint as words, sum(tokens)::bigint as tokens, max(words)::bigint as longest from {_SENTENCE_ROWS} group by doc_id")
def sentence_words(spark, sf_dir):
    rows = _sentence_rows(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), F.max("words").cast("long").alias("longest"))


@_register("long_by_lang", f"select lang, count(*) as sentences, count(*) filter (words > 30) as long_sentences, max(words)::bigint as longest from {_SENTENCE_ROWS} group by lang")
def long_by_lang(spark, sf_dir):
    rows = _sentence_rows(spark, sf_dir)
    return rows.groupBy("lang").agg(F.count("*").alias("sentences"), F.count_if(F.col("words") > 30).alias("long_sentences"), F.max("words").cast("long").alias("longest"))


@_register("fence_masks", prelude() + "select doc_id, n::int as n, line, hidden, fenced from fences")
def fence_masks(spark, sf_dir):
    return _dressed(spark, sf_dir).select("doc_id", F.inline(lines_of(F.col("text")))).select("doc_id", "n", "line", "hidden", "fenced")


@_register("paragraphs", prelude() + "select doc_id, start::int as start, n_lines::int as n_lines, joined from paras")
def paragraphs(spark, sf_dir):
    rows = with_structure(_dressed(spark, sf_dir)).select("doc_id", "lines", F.explode("paras").alias("p"))
    part = F.slice("lines", F.col("p.start"), F.col("p.n_lines"))
    return rows.select("doc_id", "p.start", "p.n_lines", F.array_join(F.transform(part, lambda x: strip(x["line"])), " ").alias("joined"))


@_register("first_words", prelude() + "select f as first_word, count(*) as n from para_sentences where f <> '' group by f")
def first_words(spark, sf_dir):
    rows = with_structure(_dressed(spark, sf_dir)).select(F.explode("paras.firsts").alias("firsts")).select(F.explode("firsts").alias("first_word"))
    return rows.where("first_word <> ''").groupBy("first_word").agg(F.count("*").alias("n"))


# Detectors, one query each.

_NAMES = {
    "cliche": "RULE-05", "jargon": "RULE-06", "long_sentences": "RULE-12", "bullets": "RULE-A", "dash": "RULE-B", "same_starts": "RULE-C",
    "opener": "RULE-D", "closers": "RULE-E", "heading_case": "RULE-G", "contraction": "RULE-I",
}


def _detector(rule: str) -> Query:
    def query(spark, sf_dir):
        column = next(c for (r, _), c in all_detectors().items() if r == rule)
        rows = with_structure(_dressed(spark, sf_dir)).select("doc_id", F.inline(column))
        return rows.select("doc_id", "line", F.col("column").alias("col"), "excerpt", "detail")

    return query


for _name, _rule in _NAMES.items():
    _register(_name, prelude() + f"select doc_id, line, col, excerpt, detail from v where rule = '{_rule}'")(_detector(_rule))


@_register(
    "cliche_order",
    prelude() + "select doc_id, string_agg(line || ':' || col || ' ' || detail, ' | ' order by ord, line, col, seq) as found, count(*) as n from v where rule = 'RULE-05' group by doc_id",
)
def cliche_order(spark, sf_dir):
    """Violation order inside a result: phrase first, then place."""
    column = all_detectors()["RULE-05", "mechanical"]
    rows = with_structure(_dressed(spark, sf_dir)).select("doc_id", column.alias("v")).where(F.size("v") > 0)
    text = F.transform("v", lambda x: F.format_string("%d:%d %s", x["line"], x["column"], x["detail"]))
    return rows.select("doc_id", F.array_join(text, " | ").alias("found"), F.size("v").cast("long").alias("n"))


@_register(
    "excerpts",
    f"""with d as (select doc_id, {dressed_sql()} as t, (doc_id * 37) % 200 as pos from documents)
    select doc_id, {excerpt_sql("t", "pos", 20)} as line_excerpt, {excerpt_sql("t", "pos", 10)} as para_excerpt from d""",
)
def excerpts(spark, sf_dir):
    at = ((F.col("doc_id") * 37) % 200).cast("int")
    return _dressed(spark, sf_dir).select("doc_id", excerpt(F.col("text"), at, 20).alias("line_excerpt"), excerpt(F.col("text"), at, 10).alias("para_excerpt"))


# Audit.

_RESULT = ["doc_id", "place", "rule", "severity", "detector", "status", "count", "note"]


def _audited(spark, sf_dir, **options) -> DataFrame:
    return au.audit(_dressed(spark, sf_dir).select("doc_id", "text"), **options)


@_register("audit_results", prelude() + f"select {', '.join(_RESULT)} from audit")
def audit_results(spark, sf_dir):
    return au.rule_results(_audited(spark, sf_dir, counts_only=True)).select(*_RESULT)


@_register("audit_mech_only", prelude() + f"select {', '.join(_RESULT)} from mech")
def audit_mech_only(spark, sf_dir):
    return au.rule_results(_audited(spark, sf_dir, mechanical_only=True, counts_only=True)).select(*_RESULT)


@_register("audit_totals", prelude() + "select doc_id, sum(count)::int as total_violations, count(*) filter (status = 'skipped') as skipped from audit group by doc_id")
def audit_totals(spark, sf_dir):
    skipped = F.size(F.filter("rule_results", lambda r: r["status"] == "skipped")).cast("long")
    return _audited(spark, sf_dir, counts_only=True).select("doc_id", "total_violations", skipped.alias("skipped"))


@_register("audit_violations", prelude() + "select doc_id, rule, line, col, excerpt, detail from v")
def audit_violations(spark, sf_dir):
    return au.violations(_audited(spark, sf_dir)).select("doc_id", "rule", "line", F.col("column").alias("col"), "excerpt", "detail")


@_register("audit_raw_totals", prelude(_RAW) + "select lang, sum(count)::bigint as violations, count(distinct doc_id) as documents from audit join docs using (doc_id) group by lang")
def audit_raw_totals(spark, sf_dir):
    audited = au.audit(_raw(spark, sf_dir).select("doc_id", "lang", "text"), counts_only=True)
    return audited.groupBy("lang").agg(F.sum("total_violations").alias("violations"), F.count("*").alias("documents"))


@_register("rule_totals", prelude() + "select rule, sum(count)::bigint as violations, count(*) filter (status = 'violation') as results from audit group by rule")
def rule_totals(spark, sf_dir):
    flat = au.rule_results(_audited(spark, sf_dir, counts_only=True))
    return flat.groupBy("rule").agg(F.sum("count").alias("violations"), F.count_if(F.col("status") == "violation").alias("results"))


@_register("status_counts", prelude() + "select detector, status, count(*) as n from audit group by detector, status")
def status_counts(spark, sf_dir):
    return au.rule_results(_audited(spark, sf_dir, counts_only=True)).groupBy("detector", "status").agg(F.count("*").alias("n"))


@_register("skipped_rules", prelude() + "select string_agg(distinct rule, ',' order by rule) as rules, count(distinct rule) as n from audit where status = 'skipped'")
def skipped_rules(spark, sf_dir):
    found = au.rule_results(_audited(spark, sf_dir, skipped_only=True)).agg(F.sort_array(F.collect_set("rule")).alias("r"))
    return found.select(F.array_join("r", ",").alias("rules"), F.size("r").cast("long").alias("n"))


@_register("top5_per_rule", prelude() + "select doc_id, rule, k::int as k, line, col, detail from (select *, row_number() over (partition by doc_id, rule order by ord, line, col, seq) as k from v) where k <= 5")
def top5_per_rule(spark, sf_dir):
    hits = au.rule_results(_audited(spark, sf_dir)).where("status = 'violation'")
    rows = hits.select("doc_id", "rule", F.posexplode(F.slice("violations", 1, 5)).alias("k", "v"))
    return rows.select("doc_id", "rule", (F.col("k") + 1).alias("k"), "v.line", F.col("v.column").alias("col"), "v.detail")


_ORDERED = "order by ord, line, col, seq"


@_register(
    "review_json",
    prelude()
    + f""", vs as (select doc_id, rule, string_agg('{{"column":' || col || ',"detail":' || to_json(detail)::varchar || ',"excerpt":' || to_json(excerpt)::varchar || ',"line":' || line || '}}', ',' {_ORDERED}) as items from v group by doc_id, rule)
    select doc_id, '{{"command":"review","file":"docs/' || doc_id || '.md","rule_results":[' || string_agg('{{"count":' || count || ',"detector":"' || detector || '","note":' || to_json(note)::varchar || ',"rule":"' || rule
      || '","severity":"' || severity || '","status":"' || status || '","violations":[' || case when status = 'violation' then items else '' end || ']}}', ',' order by place)
      || '],"rules_source":"package-bundle","total_violations":' || sum(count) || '}}' as review_json
    from audit left join vs using (doc_id, rule) group by doc_id""",
)
def review_json(spark, sf_dir):
    file = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return au.canonical_json(_audited(spark, sf_dir), canon.posix_path(file)).select("doc_id", "review_json")


def _json_lines(*lines: str) -> str:
    """SQL for lines of text: each is quoted text with SQL between double bars."""
    return " || chr(10) || ".join(" || ".join(lit(x) if k % 2 == 0 else x for k, x in enumerate(line.split("||"))) for line in lines)


@_register(
    "review_text",
    prelude()
    + f""", vs as (select doc_id, rule, string_agg({_json_lines("        {", '          "column": ||col||,', '          "detail": ||to_json(detail)::varchar||,', '          "excerpt": ||to_json(excerpt)::varchar||,', '          "line": ||line', "        }")}, ',' || chr(10) {_ORDERED}) as items from v group by doc_id, rule)
    select doc_id, sha256({_json_lines("{", '  "command": "review",', '  "file": "docs/||doc_id||.md",', '  "rule_results": [')} || chr(10) || string_agg({_json_lines(
        "    {", '      "count": ||count||,', '      "detector": "||detector||",', '      "note": ||to_json(note)::varchar||,', '      "rule": "||rule||",', '      "severity": "||severity||",', '      "status": "||status||",')}
      || chr(10) || '      "violations": ' || case when status = 'violation' then '[' || chr(10) || items || chr(10) || '      ]' else '[]' end || chr(10) || '    }}', ',' || chr(10) order by place)
      || chr(10) || {_json_lines("  ],", '  "rules_source": "package-bundle",', '  "total_violations": ||sum(count)', "}", "")}) as digest
    from audit left join vs using (doc_id, rule) group by doc_id""",
)
def review_text(spark, sf_dir):
    """The review as the command line prints it: indented, keys sorted, other characters than ASCII kept."""
    file = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return au.review_text(_audited(spark, sf_dir), canon.posix_path(file)).select("doc_id", F.sha2("review_text", 256).alias("digest"))


@_register(
    "review_report",
    prelude()
    + """, shown as (select doc_id, rule, string_agg('    L' || line || ':C' || col || '  ' || detail || chr(10), '' order by k) as items
      from (select *, row_number() over (partition by doc_id, rule order by ord, line, col, seq) as k from v) where k <= 5 group by doc_id, rule)
    select doc_id, 'review docs/' || doc_id || '.md: ' || sum(count) || ' violation(s)' || chr(10)
      || coalesce(string_agg('  ' || rule || ' [' || severity || ', ' || detector || ']: ' || count || chr(10) || items, '' order by place) filter (status = 'violation'), '')
      || '  (' || count(*) filter (status = 'skipped') || ' rule(s) skipped; they need a judge)' || chr(10) as report
    from audit left join shown using (doc_id, rule) group by doc_id""",
)
def review_report(spark, sf_dir):
    file = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return au.human_report(_audited(spark, sf_dir), file).select("doc_id", "report")


# Comparison: plain texts (a) against dressed ones (b).

_PAIRS = prelude(f"select doc_id * 2 as doc_id, coalesce(text, '') as text from documents union all select doc_id * 2 + 1, {dressed_sql()} from documents")
_DELTAS = (
    _PAIRS
    + ", deltas as (select doc_id // 2 as doc_id, rule, coalesce(sum(count) filter (doc_id % 2 = 0), 0)::bigint as a, coalesce(sum(count) filter (doc_id % 2 = 1), 0)::bigint as b from mech group by all)"
)


@_register("compare_delta", _DELTAS + " select doc_id, rule, a, b, b - a as delta from deltas")
def compare_delta(spark, sf_dir):
    return au.compare(_raw(spark, sf_dir), _dressed(spark, sf_dir))


@_register("compare_totals", _DELTAS + " select doc_id, sum(a)::bigint as total_a, sum(b)::bigint as total_b from deltas group by doc_id")
def compare_totals(spark, sf_dir):
    return au.compare_totals(compare_delta(spark, sf_dir))


@_register(
    "compare_text",
    _DELTAS
    + f""" select doc_id, sha256({_json_lines("{", '  "command": "review-compare",', '  "file_a": "a/||doc_id||.md",', '  "file_b": "b/||doc_id||.md",', '  "per_rule_delta": {')} || chr(10)
      || string_agg({_json_lines('    "||rule||": {', '      "a": ||a||,', '      "b": ||b||,', '      "delta": ||b - a', "    }")}, ',' || chr(10) order by rule)
      || chr(10) || {_json_lines("  },", '  "rules_source": "package-bundle",', '  "total_a": ||sum(a)||,', '  "total_b": ||sum(b)', "}", "")}) as digest from deltas group by doc_id""",
)
def compare_text(spark, sf_dir):
    file = lambda side: F.concat(F.lit(f"{side}/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return au.compare_text(compare_delta(spark, sf_dir), file("a"), file("b")).select("doc_id", F.sha2("compare_text", 256).alias("digest"))


# Scorecards.


@_register("task_scorecard", prelude(DRAFTS) + SCORES + "select t.runner, t.task, baseline, treatment, treatment - baseline as delta, coalesce(dominant, '—') as dominant from task_sums t left join dominant using (runner, task)")
def task_scorecard(spark, sf_dir):
    return sc.task_rows(sc.draft_counts(_drafts(spark, sf_dir)))


@_register("rule_scorecard", prelude(DRAFTS) + SCORES + "select runner, rule, baseline, treatment, treatment - baseline as delta from rule_sums")
def rule_scorecard(spark, sf_dir):
    return sc.rule_rows(sc.draft_counts(_drafts(spark, sf_dir)))


@_register(
    "totals_pct",
    prelude(DRAFTS) + SCORES + """select runner, baseline, treatment, treatment - baseline as delta,
    case when baseline = 0 then 'n/a' else printf('%+.0f%%', 100.0 * (treatment - baseline) / baseline) end as pct from totals""",
)
def totals_pct(spark, sf_dir):
    return sc.total_rows(sc.draft_counts(_drafts(spark, sf_dir)))


_LANGS = ["de", "en", "es", "fr"]


@_register(
    "rule_matrix",
    prelude(DRAFTS)
    + SCORES
    + "select rule, "
    + ", ".join(f"printf(case when x_{r} > 0 then '+%d' else '%d' end, x_{r}) as {r}" for r in _LANGS)
    + " from (select rule, "
    + ", ".join(f"coalesce(sum(treatment - baseline) filter (runner = '{r}'), 0)::bigint as x_{r}" for r in _LANGS)
    + " from rule_sums group by rule)",
)
def rule_matrix(spark, sf_dir):
    return sc.matrix(sc.rule_rows(sc.draft_counts(_drafts(spark, sf_dir))))


# Files: canonical bytes, signatures, marked blocks, manifests.

_OWNER = canon.OWNER
_MESSY = "chr(65279) || replace(coalesce(text, ''), chr(10), case when doc_id % 2 = 0 then chr(13) || chr(10) else chr(13) end) || chr(10) || chr(10)"
_CANON = "regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n+$', '') || chr(10)"


def _messy(spark, sf_dir) -> DataFrame:
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    text = F.concat(F.lit("\ufeff"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), end), F.lit("\n\n"))
    return _raw(spark, sf_dir).select("doc_id", text.alias("text"))


@_register("canonical_hash", f"select doc_id, sha256({_CANON}) as digest, strlen({_CANON})::bigint as n_bytes from documents")
def canonical_hash(spark, sf_dir):
    rows = _messy(spark, sf_dir)
    return rows.select("doc_id", canon.canonical_hash(F.col("text")).alias("digest"), F.octet_length(canon.canonical(F.col("text"))).cast("long").alias("n_bytes"))


_SIGNED = f"""{_CANON} || '<!-- owned-by: {_OWNER}; version: v1.2; sha256: ' || sha256({_CANON}) || ' -->' || chr(10)"""


@_register(
    "sign_verify",
    f"""select doc_id, sha256({_SIGNED}) as signed_digest, 'valid' as untouched,
    case when doc_id % 3 = 0 then 'mismatch' when doc_id % 3 = 1 then 'unsigned' else 'valid' end as touched, sha256({_CANON}) as declared from documents""",
)
def sign_verify(spark, sf_dir):
    plain = _raw(spark, sf_dir).select("doc_id", canon.canonical(F.coalesce("text", F.lit(""))).alias("text"))
    signed = plain.select("doc_id", canon.sign(F.col("text"), "1.2").alias("s"))
    edited = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), "s")).when(F.col("doc_id") % 3 == 1, F.concat("s", F.lit("x"))).otherwise(F.col("s"))
    return signed.select(
        "doc_id", F.sha2("s", 256).alias("signed_digest"), canon.verify(F.col("s")).alias("untouched"), canon.verify(edited).alias("touched"), canon.signature(F.col("s"))["sha256"].alias("declared")
    )


_BLOCK = f"'<!-- BEGIN {_OWNER} v2.0 -->' || chr(10) || 'New ' || lang || chr(10) || '<!-- END {_OWNER} -->'"
_OLD = f"'<!-- BEGIN {_OWNER} v1.0 -->' || chr(10) || 'old' || chr(10) || '<!-- END {_OWNER} -->'"


def _with_block(spark, sf_dir) -> DataFrame:
    """A third of the texts without a block, a third with one, a third with two beginnings."""
    old = f"<!-- BEGIN {_OWNER} v1.0 -->\nold\n<!-- END {_OWNER} -->"
    t = F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, F.concat(t, F.lit(f"\n\n\n{old}\n\n"), t)).otherwise(F.concat(F.lit(f"<!-- BEGIN {_OWNER} -->\n{old}"), t))
    return _raw(spark, sf_dir).select("doc_id", "lang", text.alias("text"))


@_register(
    "marker_upsert",
    f"""select doc_id, case doc_id % 3 when 0 then 'create' when 1 then 'update-marker' else 'error' end as action,
    sha256(case doc_id % 3 when 0 then t || case when t = '' then '' when t like '%' || chr(10) || chr(10) then '' when t like '%' || chr(10) then chr(10) else chr(10) || chr(10) end || {_BLOCK} || chr(10)
      when 1 then t || chr(10) || chr(10) || chr(10) || {_BLOCK} || chr(10) || chr(10) || t else '<!-- BEGIN {_OWNER} -->' || chr(10) || {_OLD} || t end) as digest
    from (select doc_id, lang, coalesce(text, '') as t from documents)""",
)
def marker_upsert(spark, sf_dir):
    content = F.concat(F.lit("\nNew "), "lang", F.lit("\n\n"))
    done = _with_block(spark, sf_dir).select("doc_id", canon.upsert_block(F.col("text"), "2.0", content).alias("x"))
    return done.select("doc_id", "x.action", F.sha2("x.text", 256).alias("digest"))


@_register(
    "marker_remove",
    f"""select doc_id, case doc_id % 3 when 0 then 'noop' when 1 then 'remove-marker' else 'error' end as action,
    sha256(case doc_id % 3 when 0 then t when 1 then case when l <> '' and r <> '' then l || chr(10) || chr(10) || r else l || r end
      else '<!-- BEGIN {_OWNER} -->' || chr(10) || {_OLD} || t end) as digest
    from (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '\\n+$', '') as l, regexp_replace(coalesce(text, ''), '^\\n+', '') as r from documents)""",
)
def marker_remove(spark, sf_dir):
    done = _with_block(spark, sf_dir).select("doc_id", canon.remove_block(F.col("text")).alias("x"))
    return done.select("doc_id", "x.action", F.sha2("x.text", 256).alias("digest"))


_PATH = "'docs/' || lang || '/' || doc_id || '.md'"


@_register(
    "manifest_drift",
    f"""select {_PATH} as path, case when doc_id % 5 = 0 then 'missing' when doc_id % 5 = 1 then 'drifted' else 'unchanged' end as state from documents where doc_id % 7 <> 0
    union all select {_PATH}, 'unlisted' from documents where doc_id % 7 = 0 and doc_id % 5 <> 0""",
)
def manifest_drift(spark, sf_dir):
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = _raw(spark, sf_dir).select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    manifest = rows.where("doc_id % 7 <> 0").select("path", canon.canonical_hash(F.col("text")).alias("sha256"))
    present = rows.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("edited "), "text")).otherwise(F.col("text")).alias("text"))
    return registry.drift(manifest, present)


@_register(
    "surface_coverage",
    """with t as (select lang as tool, list_sort(list_distinct(list(source))) as active from documents group by lang),
    g as (select lang as tool, list_sort(list_distinct(list(source))) as covered from documents where doc_id % 3 = 0 group by lang)
    select tool, array_to_string(active, ',') as active, array_to_string(list_sort(list_filter(active, lambda x: list_contains(covered, x))), ',') as served,
           array_to_string(list_sort(list_filter(active, lambda x: not list_contains(covered, x))), ',') as uncovered from (select tool, active, coalesce(covered, []) as covered from t left join g using (tool))""",
)
def surface_coverage(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    targets = raw.groupBy(F.col("lang").alias("tool")).agg(F.collect_set("source").alias("active"))
    covered = raw.where("doc_id % 3 = 0").groupBy(F.col("lang").alias("tool")).agg(F.collect_set("source").alias("covered"))
    return registry.coverage(targets, covered)


@_register(
    "uncovered_targets",
    """with files as (select lang || '/' || source || '/' || doc_id || '.md' as path, doc_id from documents), listed as (select path from files where doc_id % 9 = 0),
    t as (select doc_id as tool, case doc_id % 3 when 0 then lang || '/' || source || '/' || doc_id || '.md' when 1 then lang || '/' || source || '/' else lang || '/' || doc_id end as target_path from documents),
    u as (select *, regexp_replace(target_path, '/+$', '') as x from t)
    select tool, target_path from u where exists (select 1 from files f where f.path = x or starts_with(f.path, x || '/')) and not exists (select 1 from listed f where f.path = x or starts_with(f.path, x || '/'))""",
)
def uncovered_targets(spark, sf_dir):
    rows = _raw(spark, sf_dir)
    ident = F.col("doc_id").cast("string")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), ident, F.lit(".md"))
    target = F.when(F.col("doc_id") % 3 == 0, path).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("/"), "source", F.lit("/"))).otherwise(F.concat("lang", F.lit("/"), ident))
    files = rows.select(path.alias("path"), "doc_id")
    return registry.uncovered_targets(rows.select(F.col("doc_id").alias("tool"), target.alias("target_path")), files.select("path"), files.where("doc_id % 9 = 0").select("path"))


@_register(
    "tool_registry",
    """select doc_id::varchar as name, case when doc_id % 6 = 2 and doc_id % 4 >= 2 then 'target_path' else '' end as missing,
    case when doc_id % 6 = 4 and doc_id % 3 = 1 then 'adapter_source' else '' end as unwanted from documents""",
)
def tool_registry(spark, sf_dir):
    """Registry files of 1,000 tools each, written and scanned again, and the fields that a tool's mode asks for."""
    k = F.col("doc_id")
    mode = F.element_at(F.array(*map(F.lit, registry.MODES)), (k % 6 + 1).cast("int"))
    tool = F.struct(k.cast("string").alias("name"), mode.alias("install_mode"), F.when(k % 4 < 2, F.col("source")).alias("target_path"), F.when(k % 3 == 1, F.col("lang")).alias("adapter_source"))
    files = _raw(spark, sf_dir).groupBy(F.floor(k / 1000).alias("part")).agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.collect_list(tool).alias("tools"))).alias("text"))
    path = f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    documents.write_texts(files, path, rows_per_file=1)
    found = registry.check_tools(registry.read_tools(spark, path), {"owned-file": ["target_path"]}, {"print-only": ["adapter_source"]})
    return found.select("name", F.array_join("missing", ",").alias("missing"), F.array_join("unwanted", ",").alias("unwanted"))


@_register(
    "plan_actions",
    """select doc_id // 50 as plan, sha256('[' || string_agg('{"content_sha256_after":"' || sha256(coalesce(text, '')) || '","content_sha256_before":' || case when doc_id % 2 = 0 then '"' || sha256(source) || '"' else 'null' end
      || ',"op":"' || case when doc_id % 2 = 0 then 'write' else 'create' end || '","order":' || (doc_id % 50) || ',"path":"' || lang || '/' || doc_id || '"}', ',' order by lang || '/' || doc_id) || ']') as digest
    from documents group by plan""",
)
def plan_actions(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    rows = _raw(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 50).alias("plan"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.when(even, "write").otherwise("create").alias("op"),
        (F.col("doc_id") % 50).alias("order"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256_after"), F.when(even, F.sha2("source", 256)).alias("content_sha256_before"),
    )
    return registry.actions_json(rows).select("plan", F.sha2("actions_json", 256).alias("digest"))


@_register(
    "manifest_faults",
    """select doc_id, case doc_id % 9 when 0 then null when 1 then 'no JSON' when 2 then 'no object' when 3 then 'entries is no list' when 4 then 'entry 1 is no object'
      when 5 then 'entry 1 has no path' when 6 then 'entry 1 has another kind than file' when 7 then 'entry 1 has no valid sha256' end as error from documents""",
)
def manifest_faults(spark, sf_dir):
    entry = lambda path='"b"', kind="file", more="": F.concat(F.lit(f'{{"path":{path},"kind":"{kind}","sha256":"'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(f'{more}"}}'))
    whole = lambda second: F.concat(F.lit('{"entries":['), entry('"a"'), F.lit(","), second, F.lit("]}"))
    texts = [whole(entry()), F.lit('{"entries":['), F.lit("[1]"), F.lit('{"entries":{}}'), whole(F.lit('"x"')), whole(entry("7")), whole(entry(kind="dir")), whole(entry(more="0")), F.lit('{"entries":[]}')]
    text = F.element_at(F.array(*texts), (F.col("doc_id") % 9 + 1).cast("int"))
    return registry.manifest_errors(_raw(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id")


# Text files and line ends.


@_register(
    "normalised_texts",
    """select doc_id, sha256(case when ends_with(x, chr(10)) then x else x || chr(10) end) as read_digest, sha256(regexp_replace(x, '\n+$', '') || chr(10)) as written_digest
    from (select doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10)) || case doc_id % 3 when 0 then '' when 1 then chr(10) || chr(10) else chr(10) end as x from documents)""",
)
def normalised_texts(spark, sf_dir):
    k = F.col("doc_id") % 3
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\r\n")), F.when(k == 0, "").when(k == 1, "\r\r\n").otherwise("\n"))
    digest = lambda x, name: F.sha2(x, 256).alias(name)
    return _raw(spark, sf_dir).select("doc_id", digest(documents.normalised_source(text), "read_digest"), digest(documents.lf_text(text), "written_digest"))


@_register(
    "text_files",
    """select lang, sum(len(x) - len(replace(x, chr(10), '')) + 1)::bigint as n_lines, sum(strlen(x) + 1)::bigint as n_bytes, count(*)::bigint as n_texts
    from (select lang, regexp_replace(coalesce(text, ''), '\n+$', '') as x from documents) group by lang""",
)
def text_files(spark, sf_dir):
    """Texts written in files of up to 500, a folder for each language, then scanned and listed."""
    path = f"{ensure_checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
    rows = _raw(spark, sf_dir).select("lang", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    documents.write_texts(rows, path, by=["lang"], rows_per_file=500)
    lang = F.regexp_extract("file", r"/lang=([^/]+)/", 1)
    lines = documents.read_texts(spark, path).groupBy(lang.alias("lang")).agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n")))).alias("n_lines"))
    size = documents.read_tree(spark, path, "*.txt").groupBy(lang.alias("lang")).agg(F.sum("length").alias("n_bytes"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_texts")).join(lines, "lang").join(size, "lang").select("lang", "n_lines", "n_bytes", "n_texts")


# Rule packs: each document as the directive of a pack's rules.

_RULE_TEXT = "regexp_replace(coalesce(text, ''), '[ \\n]+', ' ', 'g')"
_RULE = """#### RULE-{k}: Title {k} of {lang}  \n
- **severity**: {sev}
- **scope**: all of {lang}
- **source**: own

##### Directive

{t}

##### BAD → GOOD

- GOOD: too early
```
- BAD: in a fence
```
- BAD: one {lang}
  goes on
- GOOD: two

  goes on

- BAD: three

##### Rationale for AI Agent

Because {lang}.

"""
_PACK = "<!-- head -->\n# Pack\n\nIntro.\n\n" + _RULE.replace("{k}", "01").replace("{sev}", "Critical") + _RULE.replace("{k}", "A").replace("{sev}", "low extra")
_PACK_END = "## Last part\n\nStays.\n\n```\n#### RULE-99: in a fence\n```\n"
_SHORT = "#### RULE-{k}: Title {k} of {lang}  \n\n##### Directive\n\n{t}\n\n##### BAD → GOOD\n\n- BAD: one {lang}\n  goes on\n- GOOD: two\n\n  goes on\n\n"
_SHORT_PACK = "<!-- head -->\n# Pack\n\nIntro.\n\n" + _SHORT.replace("{k}", "01") + _SHORT.replace("{k}", "A") + _PACK_END


def _filled(template: str):
    """A template with a row's language and text, as a Column."""
    return F.concat(*[F.col(x[1:-1]) if x in ("{lang}", "{t}") else F.lit(x) for x in re.split(r"(\{lang\}|\{t\})", template) if x])


def _filled_sql(template: str) -> str:
    parts = [x[1:-1] if x in ("{lang}", "{t}") else " || chr(10) || ".join(lit(line) for line in x.split("\n")) for x in re.split(r"(\{lang\}|\{t\})", template) if x]
    return " || ".join(parts)


_PACK_ROWS = f"(select doc_id, lang, {_RULE_TEXT} as t from documents)"


def _packs(spark, sf_dir, template: str = _PACK) -> DataFrame:
    rows = _raw(spark, sf_dir).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\n]+", " ").alias("t"), "lang")
    return rows.select("doc_id", "lang", _filled(template).alias("text"))


@_register(
    "rulepack_parse",
    f"""select doc_id, k as ord, 'RULE-' || id as rule, 'Title ' || id || ' of ' || lang as title, sev as severity, 'all of ' || lang as scope, 'own' as source,
    regexp_replace({_RULE_TEXT}, '^ +| +$', '', 'g') as directive, 'Because ' || lang || '.' as rationale
    from documents cross join (values (1, '01', 'critical'), (2, 'A', 'low')) as r(k, id, sev)""",
)
def rulepack_parse(spark, sf_dir):
    return rulepack.parse(_packs(spark, sf_dir), "doc_id")


@_register("rulepack_compact", f"select doc_id, 2 as rules, 0 as errors, sha256({_filled_sql(_SHORT_PACK)}) as digest from {_PACK_ROWS}")
def rulepack_compact(spark, sf_dir):
    done = rulepack.compact(_packs(spark, sf_dir, _PACK + _PACK_END), "doc_id")
    return done.select("doc_id", "rules", F.size("errors").alias("errors"), F.sha2("compact", 256).alias("digest"))


@_register(
    "rulepack_headings",
    f"""with texts as (select doc_id, {_filled_sql(_PACK + _PACK_END)} as text from {_PACK_ROWS}),
    lines as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from texts),
    f as (select *, sum((t like '```%')::int) over (partition by doc_id order by line) % 2 as inside from lines)
    select doc_id, line::int as line, length(regexp_extract(t, '^#+'))::int as level, trim(regexp_replace(t, '^#+', '')) as title from f where inside = 0 and regexp_matches(t, '^#{{1,6}} ')""",
)
def rulepack_headings(spark, sf_dir):
    return rulepack.headings(_packs(spark, sf_dir, _PACK + _PACK_END), "doc_id")


@_register(
    "rulepack_checks",
    """select doc_id, case doc_id % 4 when 0 then '' when 1 then 'a rationale is left' when 2 then 'line ends' else 'number of rules,number of directives' end as problems, doc_id % 4 <> 3 as complete from documents""",
)
def rulepack_checks(spark, sf_dir):
    k = F.col("doc_id") % 4
    packs = _packs(spark, sf_dir).withColumn("text", F.when(k == 3, F.replace("text", F.lit("#### RULE-A:"), F.lit("#### OTHER-A:"))).otherwise(F.col("text")))
    short = rulepack.compact(_packs(spark, sf_dir), "doc_id").select("doc_id", F.concat("compact", F.when(k == 1, "##### Rationale\n").when(k == 2, "\n").when(k == 3, "\n#### RULE-B: more\n##### Directive\n").otherwise("")).alias("compact"))
    problems = rulepack.check_compact(short, 2).select("doc_id", F.array_join("problems", ",").alias("problems"))
    return problems.join(rulepack.check_depth(packs, 2).select("doc_id", "complete"), "doc_id")


@_register("rulepack_alias", f"select doc_id, sha256('note ' || lang || chr(10) || chr(10) || {_filled_sql(_PACK.removeprefix('<!-- head -->' + chr(10)))}) as digest, false as before, true as after from {_PACK_ROWS}")
def rulepack_alias(spark, sf_dir):
    alias = F.concat(F.lit("note "), "lang", F.lit("\n\n# Old title\n\nOld text.\n"))
    rows = _packs(spark, sf_dir).select("doc_id", "text", alias.alias("alias")).withColumn("fresh", rulepack.refresh_alias(F.col("alias"), F.col("text")))
    return rows.select("doc_id", F.sha2("fresh", 256).alias("digest"), rulepack.same_tail(F.col("alias"), F.col("text")).alias("before"), rulepack.same_tail(F.col("fresh"), F.col("text")).alias("after"))


@_register("rulepack_outputs", "select doc_id::varchar as path, case when doc_id % 7 = 0 then 'missing' when doc_id % 5 = 0 then 'out of date' else 'current' end as state from documents")
def rulepack_outputs(spark, sf_dir):
    fresh = rulepack.compact(_packs(spark, sf_dir), "doc_id").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("compact").alias("text"))
    old = fresh.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("old\n"))).otherwise(F.col("text")).alias("text"))
    return registry.output_states(fresh.select("path", "text"), old)


# Benchmark files: written from scorecards, then read again.


@_register("scorecard_round_trip", prelude(DRAFTS) + SCORES + "select runner, rule, r.baseline, r.treatment, r.treatment - r.baseline as delta, t.baseline as total_baseline, t.treatment as total_treatment from rule_sums r join totals t using (runner)")
def scorecard_round_trip(spark, sf_dir):
    counts = sc.draft_counts(_drafts(spark, sf_dir))
    return benchmark.scan_scorecards(benchmark.render_scorecards(counts, "1.0", 2))


@_register(
    "matrix_text",
    prelude(DRAFTS)
    + SCORES
    + """, rows as (select 1 as part, runner as k, '| ' || runner || ' | ' || baseline || ' | ' || treatment || ' | ' || printf(case when treatment > baseline then '+%d' else '%d' end, treatment - baseline)
      || ' | ' || case when baseline = 0 then 'n/a' else printf('%+.0f%%', 100.0 * (treatment - baseline) / baseline) end || ' |' as line from totals
    union all select 2, rule, '| ' || rule || ' | ' || """
    + " || ' | ' || ".join(f"printf(case when x_{r} > 0 then '+%d' else '%d' end, x_{r})" for r in _LANGS)
    + " || ' |' from (select rule, "
    + ", ".join(f"coalesce(sum(treatment - baseline) filter (runner = '{r}'), 0)::bigint as x_{r}" for r in _LANGS)
    + " from rule_sums group by rule)) select part, k, line from rows",
)
def matrix_text(spark, sf_dir):
    counts = sc.draft_counts(_drafts(spark, sf_dir))
    return benchmark.matrix_lines(counts)


@_register(
    "matrix_document",
    _ORACLES["matrix_text"].removesuffix("select part, k, line from rows")
    + """select sha256('# Benchmark v1.0 (matrix)' || chr(10) || chr(10) || '- Models compared: ' || count(*) filter (part = 1) || chr(10) || '- Date: 2001-09-09' || chr(10) || chr(10)
      || '## Totals' || chr(10) || chr(10) || '| Model | Baseline | Treatment | Δ | Δ% |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg(line, chr(10) order by k) filter (part = 1)
      || chr(10) || chr(10) || '## Per-rule Δ (treatment − baseline)' || chr(10) || chr(10) || '| Rule | ' || string_agg(k, ' | ' order by k) filter (part = 1) || ' |' || chr(10)
      || '|---|' || repeat('---|', (count(*) filter (part = 1))::int) || chr(10) || string_agg(line, chr(10) order by k) filter (part = 2) || chr(10) || chr(10) || '_Numbers are directional._' || chr(10)) as digest from rows""",
)
def matrix_document(spark, sf_dir):
    """The matrix as a whole text, with the runners found in the data and a fixed moment as its date."""
    counts = sc.draft_counts(_drafts(spark, sf_dir))
    return benchmark.render_matrix(counts, None, "1.0", date=F.timestamp_seconds(F.lit(1_000_000_000))).select(F.sha2("text", 256).alias("digest"))


@_register("task_file_scan", "select 'file-' || lang as file, 'task-' || doc_id as task, regexp_replace(coalesce(text, ''), '[ \\n]+', ' ', 'g') || chr(10) || lang as prompt from documents")
def task_file_scan(spark, sf_dir):
    rows = _raw(spark, sf_dir).select("lang", "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\n]+", " ").alias("t"))
    one = F.concat(F.lit('<task id="task-'), F.col("doc_id").cast("string"), F.lit('">\n<prompt>\n'), "t", F.lit("\n"), "lang", F.lit("\n</prompt>\n</task>\n"))
    files = rows.groupBy("lang", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.array_join(F.sort_array(F.collect_list(one)), "\n").alias("text"))
    return benchmark.scan_tasks(files.select(F.concat(F.lit("file-"), "lang").alias("file"), F.concat(F.lit("# Tasks\n\n"), "text").alias("text")))


def queries() -> dict[str, Query]:
    return _QUERIES | registers.QUERIES | releases.QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES | registers.ORACLES | releases.ORACLES
