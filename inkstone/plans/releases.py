"""Queries on blocks of Markdown, packs near folders, versions and dates, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.runtime import table
from inkstone.sources import blocks, rulepack, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


_HEAD = "Title of {lang}\\n{under}\\n\\n````\\n# no\\n```\\n# no\\n````\\n<div>\\n# no\\n\\n## Of {source} ##\\n- # no\\n---\\n"
_TAIL = "\\n\\n    # no\\n\\nLast of {source}\\nin {lang}\\n---\\n".replace("\\n", "\n")
_HEAD = _HEAD.replace("\\n", "\n")


@_register(
    "block_headings",
    r"""with b as (select doc_id, lang, source, doc_id % 2 = 0 as one, len(string_split(coalesce(text, ''), chr(10))) as n from documents)
    select doc_id, 1 as line, 2 as last, case when one then 1 else 2 end as level, 'Title of ' || lang as title from b
    union all select doc_id, 12, 12, 2, 'Of ' || source from b
    union all select doc_id, 19 + n, 21 + n, 2, 'Last of ' || source || chr(10) || 'in ' || lang from b""",
)
def block_headings(spark, sf_dir):
    """Documents (letters and blanks of each line, behind a letter) between blocks that hold what looks like headings."""
    rows = _rows(spark, sf_dir)
    body = F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z \n]", ""), r"(?m)^", "x")
    lang, source = F.col("lang"), F.col("source")
    under = F.when(F.col("doc_id") % 2 == 0, "===").otherwise("---")
    head = F.replace(F.replace(F.replace(F.lit(_HEAD), F.lit("{lang}"), lang), F.lit("{under}"), under), F.lit("{source}"), source)
    tail = F.replace(F.replace(F.lit(_TAIL), F.lit("{lang}"), lang), F.lit("{source}"), source)
    return blocks.headings(rows.select("doc_id", F.concat(head, F.lit("\n"), body, tail).alias("text")), "doc_id")


@_register(
    "nearest_packs",
    """with f as (select doc_id, 'p/' || lang || '/' || source || '/' || doc_id as folder, lang, source from documents),
    langs as (select distinct lang from f where lang <> 'en'), sources as (select distinct lang, source from f where doc_id % 10 = 0)
    select folder, case when path is null then 'package-bundle' else 'project-local' end as source, coalesce(path, '/usr/RULES.md') as path from (
      select folder, case when doc_id % 7 = 0 then folder || '/RULES.md' when s.source is not null then 'p/' || f.lang || '/' || f.source || '/RULES.md' when l.lang is not null then 'p/' || f.lang || '/RULES.md' end as path
      from f left join sources s on s.lang = f.lang and s.source = f.source left join langs l on l.lang = f.lang)""",
)
def nearest_packs(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    near = F.concat(F.lit("p/"), "lang", F.lit("/"), "source")
    folder = F.concat(near, F.lit("/"), F.col("doc_id").cast("string"))
    pack = lambda where, at: rows.where(where).select(F.concat(at, F.lit("/RULES.md")).alias("path"))
    files = pack("doc_id % 7 = 0", folder).unionByName(pack("doc_id % 10 = 0", near)).unionByName(pack("lang <> 'en'", F.concat(F.lit("p/"), "lang")))
    other = rows.select(F.concat(folder, F.lit("/OTHER.md")).alias("path"))
    return rulepack.resolve_all(rows.select(folder.alias("folder")), files.unionByName(other), bundle="/usr/RULES.md")


@_register(
    "version_rewrites",
    """with f as (select doc_id, coalesce(text, '') as t, case doc_id % 4 when 0 then 'CHANGELOG.md' when 1 then 'a/' || doc_id || '.txt' else 'a/' || doc_id || '.md' end as path, doc_id % 3 as k from documents),
    g as (select *, case k when 0 then t when 1 then t || ' v1.2.0' else 'pkg@1.2.0 ' || t || ' "1.2.0"' end as before, case k when 0 then t when 1 then t || ' v1.3.0' else 'pkg@1.3.0 ' || t || ' "1.3.0"' end as after from f),
    s as (select *, doc_id % 4 > 1 as inside, doc_id % 5 = 0 and k < 2 as short from g)
    select doc_id, path, (case when inside then k else 0 end)::bigint as replaced, case when not inside then 'skipped' when short then 'short' when k = 0 then 'unchanged' else 'updated' end as state,
      sha256(case when inside and not short then after else before end) as digest from s""",
)
def version_rewrites(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    ident, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    path = F.when(F.col("doc_id") % 4 == 0, "CHANGELOG.md").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("a/"), ident, F.lit(".txt"))).otherwise(F.concat(F.lit("a/"), ident, F.lit(".md")))
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" v1.2.0"))).otherwise(F.concat(F.lit("pkg@1.2.0 "), "text", F.lit(' "1.2.0"')))
    # The number goes along in front of the path, since some paths repeat.
    tagged = F.concat(ident, F.lit(":"), path)
    files = rows.select(F.when(path == "CHANGELOG.md", path).otherwise(tagged).alias("path"), text.alias("text"), "doc_id")
    named = files.where("path <> 'CHANGELOG.md'")
    required = rows.where("doc_id % 5 = 0").select(tagged.alias("path"), F.lit(2).cast("long").alias("least"))
    done = versions.rewrite(named.select("path", "text"), "1.2.0", "1.3.0", "pkg", required)
    done = done.select(F.substring_index("path", ":", 1).cast("long").alias("doc_id"), F.substring_index("path", ":", -1).alias("path"), "replaced", "state", F.sha2("text", 256).alias("digest"))
    kept = versions.rewrite(files.where("path = 'CHANGELOG.md'").select("path", "text"), "1.2.0", "1.3.0", "pkg").groupBy("path", "replaced", "state", "text").agg(F.count("*").alias("n"))
    whole = rows.where("doc_id % 4 = 0").select("doc_id", text.alias("text"))
    logs = whole.join(kept, "text").select("doc_id", "path", F.col("replaced").cast("long").alias("replaced"), "state", F.sha2("text", 256).alias("digest"))
    return done.unionByName(logs)
