"""Queries on registries and installations, and their SQL: every document is a tool or a project of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import canon
from inkstone.runtime import table
from inkstone.sources import installation, registry_checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


# Registries of 50 tools, a kind of fault for each tool; every fifth registry has a version of its own.

_PLAIN = '"adapter_source":"a","load_class":"l","target_path":"t"'
_SKILL = '"install_mode":"skill-with-references","manual_step_message":"m","references_source":"r","skill_source":"s"'
_GROUP = '{"target_path":"%s","surfaces":["host"]}'
_SPECS = [
    f'{{"install_mode":"owned-file",{_PLAIN}}}',
    f'{{"install_mode":"by-hand",{_PLAIN}}}',
    f"{{{_PLAIN}}}",
    '{"install_mode":"print-only","adapter_source":"a","target_path":"t","target_groups":[]}',
    f'{{{_SKILL},"target_groups":[]}}',
    f'{{{_SKILL},"target_groups":[{_GROUP % "./a//b"},{_GROUP % "c"},{_GROUP % "a/b"}]}}',
    None,  # surfaces, below
    f'{{{_SKILL},"target_groups":[{_GROUP % "/etc/x"}]}}',
    f'{{{_SKILL},"target_groups":[{{"target_path":"C:x","surfaces":[]}}]}}',
    f'{{{_SKILL},"target_groups":[{_GROUP % "a/../b"},{{"target_path":7,"surfaces":["host"]}}]}}',
    f'{{{_SKILL},"target_groups":[{{"surfaces":["host"]}}],"load_class":"l"}}',
    "7",
]
_FAULTS = [
    (1, None, "'has an unknown install_mode'"), (2, None, "'misses install_mode'"), (3, None, "'misses load_class'"), (3, None, "'must not have target_groups'"),
    (4, "target_groups", "'is no list with entries'"), (5, "target_groups[2]", "'target_path is that of target_groups[0]'"),
    (6, "target_groups[0].surfaces[1]", "'names no tool that takes skills: t' || doc_id"), (6, "target_groups[0].surfaces[2]", "'names no tool that takes skills: ' || source"),
    (6, "target_groups[0].surfaces[3]", "'is no text'"), (7, "target_groups[0]", "'target_path is absolute'"), (8, "target_groups[0]", "'target_path names a drive'"),
    (8, "target_groups[0]", "'surfaces is no list with entries'"), (9, "target_groups[0]", "'target_path leaves the folder'"), (9, "target_groups[1]", "'target_path is no text'"),
    (10, "target_groups[0]", "'needs target_path and surfaces'"), (10, None, "'must not have load_class'"), (11, None, "'is no object'"),
]
_FAULT_ROWS = " union all ".join(f"select doc_id, 't' || doc_id as tool, {'null' if place is None else repr(place)} as place, {fault} as fault from sound where k = {k}" for k, place, fault in _FAULTS)


@_register(
    "registry_faults",
    f"""with docs as (select doc_id, doc_id // 50 as registry, doc_id % 12 as k, source from documents), sound as (select * from docs where registry % 5 <> 4)
    select doc_id // 50 as registry, tool, place, fault from ({_FAULT_ROWS}
      union all select doc_id, 't' || doc_id, 'target_groups[0].surfaces[4]', 'names no tool that takes skills: t' || (doc_id - 6) from sound s
        where k = 6 and not exists (select 1 from docs d where d.doc_id = s.doc_id - 6 and d.registry = s.registry))
    union all select distinct registry, null, null, 'schema_version is 2, not 1' from docs where registry % 5 = 4""",
)
def registry_faults(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.lit("t"), k.cast("string"))
    listed = F.concat(F.lit('["host","'), name, F.lit('","'), "source", F.lit('",8,"t'), (k - 6).cast("string"), F.lit('"]'))
    surfaces = F.concat(F.lit(f'{{{_SKILL},"target_groups":[{{"target_path":"x","surfaces":'), listed, F.lit("}]}"))
    spec = F.element_at(F.array(*[surfaces if s is None else F.lit(s) for s in _SPECS]), (k % 12 + 1).cast("int"))
    member = F.concat(F.lit('"'), name, F.lit('":'), spec)
    tools = _rows(spark, sf_dir).groupBy(F.floor(k / 50).alias("registry")).agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("tools"))
    version = F.when(F.col("registry") % 5 == 4, "2").otherwise("1")
    text = F.concat(F.lit('{"schema_version":'), version, F.lit(f',"tools":{{"host":{_SPECS[0]},'), "tools", F.lit("}}"))
    return registry_checks.registry_faults(tools.select("registry", text.alias("text")))


# Installations: each document is a project with one tool of each of five modes in turn, and files in five states.

_OWNER, _VERSION = canon.OWNER, "1.2"
_MODES = ["import-marker", "append-block", "owned-file", "multi-file-required", "print-only"]
_CANON = "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n+$', '') || chr(10)"
_SIGNED = f"{_CANON} || '<!-- owned-by: {_OWNER}; version: v{_VERSION}; sha256: ' || sha256({_CANON}) || ' -->' || chr(10)"
_BEGIN, _END = f"<!-- BEGIN {_OWNER} v{_VERSION} -->", f"<!-- END {_OWNER} -->"


def _block_sql(content: str) -> str:
    return rf"('{_BEGIN}' || chr(10) || regexp_replace({content}, '^\n+|\n+$', '', 'g') || chr(10) || '{_END}')"


_LINE = "case when m = 0 then '@' || source else text end"
_PROJECTS = f"""projects as (select *, {_LINE} as content from (select doc_id, coalesce(text, '') as text, lang, source, doc_id % 5 as m, (doc_id // 5) % 5 as s, doc_id % 3 as r from documents)),
    files as (select *, 'p/' || lang || '/' || doc_id as target,
      case when m <= 1 then case s when 0 then null when 1 then 'Mine.' || chr(10) || chr(10) || {_block_sql("content")} || chr(10) when 2 then 'Mine.' || chr(10) || '<!-- BEGIN {_OWNER} v0.9 -->' || chr(10) || 'old' || chr(10) || '{_END}' || chr(10) || 'More.'
          when 3 then '{_BEGIN}' || chr(10) || 'x' else 'Mine.' end
        when m = 2 then case s when 0 then null when 1 then {_SIGNED} when 2 then 'Mine.' when 3 then 'x' || {_SIGNED} else '' end
        else case s when 0 then null when 1 then text when 2 then '' else 'old' end end as have from projects)"""


@_register(
    "install_actions",
    f"""with {_PROJECTS},
    after as (select *, case when m <= 1 then case s when 0 then {_block_sql("content")} || chr(10) when 1 then have when 2 then 'Mine.' || chr(10) || {_block_sql("content")} || chr(10) || 'More.' when 4 then 'Mine.' || chr(10) || chr(10) || {_block_sql("content")} || chr(10) end
        when m = 2 then {_SIGNED} else text end as want,
      case when m <= 1 and s = 3 then 'the marks of its block are ambiguous' when m = 2 and s in (2, 4) then 'it is not signed by its owner' when m = 2 and s = 3 then 'it was edited since it was signed' end as refused from files),
    steps as (
      select doc_id, 0 as step, case when r = 0 then 'create' else 'owned-file-write' end as op, '.inkstone/RULES.md' as path, case when r = 2 then sha256('old rules') end as before, sha256('rules of ' || lang) as after from after where refused is null and r <> 1
      union all select doc_id, 1, 'owned-file-write', '.inkstone/' || source || '.md', null, sha256(text) from after where refused is null and m = 0
      union all select doc_id, 2, case when m <= 1 then case when s = 2 then 'update-marker' else 'create' end else 'owned-file-write' end, target, case when have <> '' or m >= 3 then sha256(have) end, sha256(want)
        from after where refused is null and have is distinct from want
      union all select doc_id, 3, case when m = 3 then 'print-snippet' else 'print-prompt' end, target, null, sha256(case when m = 3 then 'read: ' || source else text end) from after where m >= 3)
    select doc_id as plan, row_number() over (partition by doc_id order by step) - 1 as "order", op, path, before as content_sha256_before, after as content_sha256_after, null as message from steps
    union all select doc_id, 0, 'refuse', target, null, null, refused from after where refused is not null""",
)
def install_actions(spark, sf_dir):
    k = F.col("doc_id")
    rows = _rows(spark, sf_dir).select(
        k.alias("plan"), F.element_at(F.array(*map(F.lit, _MODES)), (k % 5 + 1).cast("int")).alias("install_mode"), F.concat(F.lit("p/"), "lang", F.lit("/"), k.cast("string")).alias("target_path"),
        F.concat(F.lit("agents/"), "source", F.lit(".md")).alias("adapter_source"), F.col("text").alias("body"), F.concat(F.lit("rules of "), "lang").alias("rules"), F.concat(F.lit("@"), "source").alias("import_line"),
        F.concat(F.lit("read: "), "source").alias("snippet"), (k % 5).alias("m"), (F.floor(k / 5) % 5).alias("s"), (k % 3).alias("r"),
    )
    shared = rows.where("r > 0").select("plan", F.lit(".inkstone/RULES.md").alias("path"), F.when(F.col("r") == 1, F.col("rules")).otherwise("old rules").alias("text"))
    return installation.actions(installation.enable_steps(rows), _present(rows).unionByName(shared), version=_VERSION)


@_register(
    "remove_actions",
    f"""with {_PROJECTS},
    done as (select *, case when m <= 1 and s = 3 then 'the marks of its block are ambiguous' when m = 2 and s in (2, 4) then 'it is not signed by its owner' when m = 2 and s = 3 then 'it was edited since it was signed' end as refused from files)
    select doc_id as plan, 0::bigint as "order", case when refused is not null then 'refuse' when m <= 1 then 'remove-marker' else 'owned-file-remove' end as op, target as path, case when refused is null then sha256(have) end as content_sha256_before,
      case when refused is null and m <= 1 then sha256(case when s = 1 then 'Mine.' else 'Mine.' || chr(10) || chr(10) || 'More.' end) end as content_sha256_after, refused as message
    from done where have is not null and not (m <= 1 and s = 4)""",
)
def remove_actions(spark, sf_dir):
    k = F.col("doc_id")
    rows = _rows(spark, sf_dir).select(
        k.alias("plan"), F.element_at(F.array(*map(F.lit, _MODES)), (k % 5 + 1).cast("int")).alias("install_mode"), F.concat(F.lit("p/"), "lang", F.lit("/"), k.cast("string")).alias("target_path"),
        F.col("text").alias("body"), F.concat(F.lit("@"), "source").alias("import_line"), (k % 5).alias("m"), (F.floor(k / 5) % 5).alias("s"),
    )
    return installation.actions(installation.disable_steps(rows), _present(rows), version=_VERSION)


def _present(rows: DataFrame) -> DataFrame:
    """The target files of projects (``body, import_line, m, s``) in their states."""
    content = F.when(F.col("m") == 0, F.col("import_line")).otherwise(F.col("body"))
    s = F.col("s")
    blocks = F.when(s == 1, canon.upsert_block(F.lit("Mine."), _VERSION, content)["text"]).when(s == 2, f"Mine.\n<!-- BEGIN {_OWNER} v0.9 -->\nold\n{_END}\nMore.").when(s == 3, f"{_BEGIN}\nx").when(s == 4, "Mine.")
    signed = canon.sign(F.col("body"), _VERSION)
    owned = F.when(s == 1, signed).when(s == 2, "Mine.").when(s == 3, F.concat(F.lit("x"), signed)).when(s == 4, "")
    copies = F.when(s == 1, F.col("body")).when(s == 2, "").when(s > 2, "old")
    have = F.when(F.col("m") <= 1, blocks).when(F.col("m") == 2, owned).otherwise(copies)
    return rows.select("plan", F.col("target_path").alias("path"), have.alias("text")).where("text is not null")


# Skills: a tool for each language with a file and a folder as target groups; each document is a project.

_SKILL_PATH, _FOLDER = "'skills/' || lang || '/SKILL.md'", "'refs/' || lang || '/'"
_SKILLS = f"""docs as (select doc_id, coalesce(text, '') as text, lang, doc_id % 7 as s, doc_id % 2 = 0 as a, doc_id % 3 = 0 as b, doc_id % 5 = 0 as c from documents),
    refs as (select lang, 'first.md' as inner_path, min(coalesce(text, '')) as body from documents group by lang union all select lang, 'last.md', max(coalesce(text, '')) from documents group by lang),
    files as (select doc_id, lang, {_SKILL_PATH} as path, text as body, case when a and b then ['a', 'b'] when a then ['a'] else ['b'] end as covered from docs where a or b
      union all select doc_id, lang, {_FOLDER} || inner_path, body, case when b and c then ['b', 'c'] when b then ['b'] else ['c'] end from docs join refs using (lang) where b or c)"""
_HASH = _CANON.replace("text", "body")


@_register(
    "skill_actions",
    f"""with {_SKILLS},
    judged as (select *, case when (a or b) and s = 0 then 'no manifest lists it' when (a or b) and s = 2 then 'it has drifted from the manifest' when (a or b) and s = 3 then 'the manifest does not list it' end as refused, a or b or c as takes from docs),
    manifests as (select doc_id, lang, '{{' || chr(10) || '  "entries": [' || chr(10) || string_agg('    {{' || chr(10) || '      "covered_surfaces": [' || chr(10) || '        "' || array_to_string(covered, '",' || chr(10) || '        "') || '"' || chr(10)
      || '      ],' || chr(10) || '      "kind": "file",' || chr(10) || '      "path": "' || path || '",' || chr(10) || '      "sha256": "' || sha256({_HASH}) || '"' || chr(10) || '    }}', ',' || chr(10) order by path) || chr(10) || '  ],' || chr(10)
      || '  "generated_by": "inkstone 1.0",' || chr(10) || '  "schema_version": 1,' || chr(10) || '  "tool": "skill-' || lang || '"' || chr(10) || '}}' || chr(10) as doc from files group by doc_id, lang),
    free as (select * from judged where refused is null and takes),
    steps as (
      select doc_id, 0 as step, 'create' as op, '.inkstone/RULES.md' as path, null as after, sha256('rules') as after_hash, null as message from free
      union all select doc_id, 1, 'owned-file-write', path, null, sha256({_HASH}), null from files f join free using (doc_id) where not (s = 1 and path like 'skills/%')
      union all select doc_id, 2, 'manifest-write', '.inkstone/skills/skill-' || m.lang || '/manifest.json', null, sha256(doc), null from manifests m join free using (doc_id)
      union all select doc_id, 3, 'print-message', '', null, null, 'not for d' from free where doc_id % 11 = 0)
    select doc_id as plan, row_number() over (partition by doc_id order by step, path) - 1 as "order", op, path, null as content_sha256_before, after_hash as content_sha256_after, message from steps
    union all select doc_id, 0, 'refuse', {_SKILL_PATH}, null, null, refused from judged where refused is not null
    union all select doc_id, 0, 'print-message', '', null, null, 'no active surface takes this skill' from judged where not takes""",
)
def skill_actions(spark, sf_dir):
    k = F.col("doc_id")
    tool = F.concat(F.lit("skill-"), "lang").alias("tool")
    rows = _rows(spark, sf_dir)
    requests = rows.select(k.alias("plan"), tool, F.col("text").alias("skill"), F.lit("rules").alias("rules"), F.lit("not for {tool}").alias("message"))
    texts = lambda *x: F.array(*map(F.lit, x))
    group = lambda path, surfaces: F.struct(path.alias("target_path"), surfaces.alias("surfaces"))
    skill, folder = F.concat(F.lit("skills/"), "lang", F.lit("/SKILL.md")), F.concat(F.lit("refs/"), "lang", F.lit("/"))
    langs = rows.groupBy("lang").agg(F.min("text").alias("first"), F.max("text").alias("last"))
    groups = langs.select(tool, F.inline(F.array(group(skill, texts("a", "b")), group(folder, texts("b", "c")))))
    bundled = F.array(*[F.struct(F.lit(f"{n}.md").alias("path"), F.col(n).alias("text")) for n in ("first", "last")])
    references = langs.select(tool, F.inline(bundled))
    file = lambda when, path, text: F.when(when, F.struct(path.alias("path"), text.alias("text")))
    s = k % 7
    there = F.when(s.isin(0, 1, 3), F.col("text")).when(s == 2, F.concat("text", F.lit("\nedited")))
    found = F.array(file(k % 2 == 0, F.lit("A.md"), F.lit("x")), file(k % 3 == 0, F.lit(".b/x.md"), F.lit("x")), file(k % 5 == 0, F.lit("C.md"), F.lit("x")), file(k % 11 == 0, F.lit("D.md"), F.lit("x")), file(there.isNotNull(), skill, there))
    present = rows.select(k.alias("plan"), F.inline(F.filter(found, lambda x: x.isNotNull())))
    surfaces = spark.createDataFrame([("a", "A.md"), ("b", ".b/"), ("c", "C.md"), ("d", "D.md")], "surface string, target_path string")
    active = installation.active_surfaces(surfaces, present)
    listed = rows.where((s > 0) & (s < 4)).select(k.alias("plan"), F.when(s < 3, skill).alias("path"), F.when(s < 3, canon.canonical_hash(F.col("text"))).alias("sha256"))
    return installation.actions(installation.skill_steps(requests, groups, references, active), present, listed)
