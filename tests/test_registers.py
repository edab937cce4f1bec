"""Registry faults, derived installation actions and indented JSON on small cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from inkstone.functions import canon
from inkstone.functions.jsontext import pretty_json
from inkstone.operators import audit as au
from inkstone.sources import installation as ins
from inkstone.sources.registry_checks import registry_faults

PLAIN = {"install_mode": "owned-file", "target_path": "x", "adapter_source": "y", "load_class": "z"}


def skill(groups, **more):
    return {"install_mode": "skill-with-references", "skill_source": "a", "references_source": "b", "target_groups": groups, "manual_step_message": "m", **more}


def faults(spark, *texts):
    rows = [(k, t if t is None or isinstance(t, str) else json.dumps({"schema_version": 1, "tools": t})) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "registry long, text string").withColumn("tool", F.lit("clash")).withColumn("row", F.lit(1))
    found = [(r.registry, r.tool, r.place, r.fault) for r in registry_faults(table).collect()]
    return sorted(found, key=lambda x: (x[0], x[1] or "", x[2] or "", x[3]))


def test_pretty_json_is_that_of_the_standard_library(spark):
    nasty = "é \x00\x01\x1f\x7f\"\\/\n\r\t\b\f𝄞" + "x" * 100_000
    value = {"z": "x", "b": nasty, "l": [1, None], "m": {}, "e": [], "n": {"b": [{"u": "q", "a": None}], "a": []}, "t": True, "q": None}
    kind = "v struct<z:string,b:string,l:array<int>,m:map<string,int>,e:array<string>,n:map<string,array<struct<u:string,a:long>>>,t:boolean,q:string>"
    row = ("x", nasty, [1, None], {}, [], {"b": [("q", None)], "a": []}, True, None)
    table = spark.createDataFrame([(row,), (None,)], kind)
    found = [r[0] for r in table.select(pretty_json(table, "v")).collect()]
    assert found == [json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n", "null\n"]
    with pytest.raises(TypeError):
        table.select(pretty_json(table.select(F.lit(1.5).alias("v")), "v"))


def test_review_and_compare_texts(spark):
    docs = spark.createDataFrame([(1, "We delve — it's “odd”.\n"), (2, None)], "doc_id long, text string").withColumn("rule", F.lit("r")).withColumn("review_text", F.lit("old"))
    audited = au.audit(docs)
    for r in au.review_text(audited, F.lit("a.md")).collect():
        assert r.rule == "r" and r.review_text == json.dumps(json.loads(r.review_text), sort_keys=True, ensure_ascii=False, indent=2) + "\n"
    one = au.canonical_json(audited, F.lit("a.md")).orderBy("doc_id").collect()
    two = au.review_text(audited, F.lit("a.md")).orderBy("doc_id").collect()
    assert [json.loads(x.review_json) for x in one] == [json.loads(x.review_text) for x in two]
    text = au.compare_text(au.compare(docs, docs.select("doc_id", F.lit("So, plain.").alias("text"))), F.lit("a"), F.lit("b")).where("doc_id = 1").collect()[0].compare_text
    told = json.loads(text)
    assert text == json.dumps(told, sort_keys=True, indent=2) + "\n"
    assert told["total_a"] == sum(v["a"] for v in told["per_rule_delta"].values()) > told["total_b"] == 0


def test_callers_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "We delve — ok.")], "doc_id long, text string")
    for name in [*au.RESULT, *au.SINGLE, "lines", "paras", "lists", "x.y"]:
        docs = docs.withColumn(name, F.lit("mine"))
    audited = au.audit(docs)
    flat = au.rule_results(audited).where("status = 'violation'")
    assert flat.count() == 2 and {"line", "x.y"} <= set(flat.columns)
    assert sorted(r.detail for r in au.violations(audited).collect()) == ["em-dash as casual punctuation", "jargon / AI-tell 'delve'"]
    renamed = docs.select(F.col("doc_id").alias("side"), F.col("text").alias("body"))
    assert au.compare(renamed, renamed, key="side", text_col="body").where("a <> b or delta <> 0").count() == 0
    with pytest.raises(ValueError, match="key"):
        au.compare(docs, docs, key="rule")


def test_all_faults_of_a_registry(spark):
    groups = [
        {"target_path": "./a//b", "surfaces": ["p", ""]}, {"target_path": "a/b", "surfaces": ["v", 3]}, {"target_path": "/abs", "surfaces": []}, {"target_path": "C:x", "surfaces": ["p"]},
        {"target_path": "a\\..\\b", "surfaces": ["p"]}, {"surfaces": ["p"]}, 5, {"target_path": "", "surfaces": None},
    ]
    tools = {"p": PLAIN, "q": {"install_mode": "nope"}, "r": {"target_path": 1}, "t": {"install_mode": "owned-file", "target_groups": []}, "u": skill([]), "v": skill(groups), "w": 7, "y": skill([{"target_path": "k", "surfaces": ["p"]}], load_class=1)}
    assert faults(spark, tools) == sorted([
        (0, "q", None, "has an unknown install_mode"), (0, "r", None, "misses install_mode"), (0, "t", None, "misses adapter_source"), (0, "t", None, "misses load_class"), (0, "t", None, "misses target_path"),
        (0, "t", None, "must not have target_groups"), (0, "u", "target_groups", "is no list with entries"), (0, "v", "target_groups[0].surfaces[1]", "is no text"),
        (0, "v", "target_groups[1]", "target_path is that of target_groups[0]"), (0, "v", "target_groups[1].surfaces[0]", "names no tool that takes skills: v"), (0, "v", "target_groups[1].surfaces[1]", "is no text"),
        (0, "v", "target_groups[2]", "surfaces is no list with entries"), (0, "v", "target_groups[2]", "target_path is absolute"), (0, "v", "target_groups[3]", "target_path names a drive"),
        (0, "v", "target_groups[4]", "target_path leaves the folder"), (0, "v", "target_groups[5]", "needs target_path and surfaces"), (0, "v", "target_groups[6]", "needs target_path and surfaces"),
        (0, "v", "target_groups[7]", "target_path is no text"), (0, "v", "target_groups[7]", "surfaces is no list with entries"), (0, "w", None, "is no object"), (0, "y", None, "must not have load_class"),
    ], key=lambda x: (x[0], x[1], x[2] or "", x[3]))


def test_faults_of_whole_registries(spark):
    found = faults(spark, None, "", "{", "[1]", '{"tools":{}}', '{"schema_version":1,"tools":[]}', {}, {"p": PLAIN}, '{"schema_version":1,"tools":{"p":{},"p":{}}}')
    assert found == [
        (0, None, None, "no JSON"), (1, None, None, "no JSON"), (2, None, None, "no JSON"), (3, None, None, "no object"), (4, None, None, "schema_version is missing, not 1"), (5, None, None, "tools is no object"), (8, None, None, "no JSON"),
    ]
    assert registry_faults(spark.createDataFrame([], "registry long, text string")).collect() == []


def test_surfaces_are_those_of_the_same_registry(spark):
    group = skill([{"target_path": "k", "surfaces": ["p"]}])
    assert faults(spark, {"p": PLAIN, "v": group}, {"v": group}) == [(1, "v", "target_groups[0].surfaces[0]", "names no tool that takes skills: p")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def request(plan, mode, **more):
    base = {"target_path": "T.md", "adapter_source": "agents/a.md", "body": "Body\n", "rules": "R\n", "import_line": "@a", "snippet": "s"} | more
    return (plan, mode, *base.values())


REQUEST = "plan long, install_mode string, target_path string, adapter_source string, body string, rules string, import_line string, snippet string"


def derived(spark, requests, present=(), **more):
    files = spark.createDataFrame(list(present), "plan long, path string, text string").withColumn("have", F.lit(1))
    found = ins.actions(ins.enable_steps(spark.createDataFrame(requests, REQUEST).withColumn("step", F.lit("x"))), files, **more)
    return [(r.plan, r.order, r.op, r.path, r.content_sha256_before, r.content_sha256_after) for r in found.orderBy("plan", "order").collect()]


def test_actions_of_a_fresh_project(spark):
    block = "<!-- BEGIN inkstone v1.0 -->\n@a\n<!-- END inkstone -->\n"
    rules = ("create", ".inkstone/RULES.md", None, sha("R\n"))
    assert derived(spark, [request(1, "import-marker"), request(2, "print-only"), request(3, "by-hand")]) == [
        (1, 0, *rules), (1, 1, "owned-file-write", ".inkstone/a.md", None, sha("Body\n")), (1, 2, "create", "T.md", None, sha(block)),
        (2, 0, *rules), (2, 1, "owned-file-write", "T.md", None, sha("Body\n")), (2, 2, "print-prompt", "T.md", None, sha("Body\n")), (3, 0, "refuse", "T.md", None, None),
    ]


def test_actions_are_none_where_all_is_right_and_repeated_files_count_once(spark):
    signed = spark.range(1).select(canon.sign(F.lit("Body\n"), "1.0")).first()[0]
    present = [(1, ".inkstone/RULES.md", "R\n"), (1, ".inkstone/RULES.md", "R\n"), (1, "T.md", signed), (2, "T.md", None), (2, ".inkstone/RULES.md", None)]
    assert derived(spark, [request(1, "owned-file"), request(2, "append-block")], present) == [
        (2, 0, "owned-file-write", ".inkstone/RULES.md", sha(""), sha("R\n")), (2, 1, "create", "T.md", None, sha("<!-- BEGIN inkstone v1.0 -->\nBody\n<!-- END inkstone -->\n")),
    ]


def test_removal(spark):
    requests = spark.createDataFrame([request(1, "print-only"), request(2, "append-block"), request(3, "owned-file")], REQUEST)
    present = spark.createDataFrame([(1, "T.md", "x"), (2, "T.md", "plain"), (3, "T.md", "mine")], "plan long, path string, text string")
    found = ins.actions(ins.disable_steps(requests), present).orderBy("plan").collect()
    assert [(r.plan, r.op, r.message) for r in found] == [(1, "owned-file-remove", None), (3, "refuse", "it is not signed by its owner")]


def test_skills(spark):
    requests = spark.createDataFrame([(p, "s", "Skill", "R", None) for p in (1, 2, 3)], "plan long, tool string, skill string, rules string, message string")
    groups = spark.createDataFrame([("s", "k/S.md", ["a", "b"]), ("s", "refs", ["a"])], "tool string, target_path string, surfaces array<string>")
    references = spark.createDataFrame([("s", "one.md", "1"), ("s", "in/two.md", None)], "tool string, path string, text string")
    active = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "plan long, surface string")
    broken = spark.createDataFrame([(2, "no JSON"), (3, "no JSON")], "plan long, error string")
    found = ins.actions(ins.skill_steps(requests, groups, references, active, broken), spark.createDataFrame([], "plan long, path string, text string"))
    told = [(r.plan, r.order, r.op, r.path) for r in found.orderBy("plan", "order").collect()]
    assert told == [
        (1, 0, "create", ".inkstone/RULES.md"), (1, 1, "owned-file-write", "k/S.md"), (1, 2, "owned-file-write", "refs/in/two.md"), (1, 3, "owned-file-write", "refs/one.md"),
        (1, 4, "manifest-write", ".inkstone/skills/s/manifest.json"), (2, 0, "refuse", ""), (3, 0, "print-message", ""),
    ]


def test_empty_tables(spark):
    assert derived(spark, []) == []


def test_nearest_packs(spark):
    from inkstone.sources.rulepack import resolve_all

    files = ["RULES.md", "a/b/RULES.md", "a/b/RULES.md", "/RULES.md", "/x/y/RULES.md", "a/b/c/OTHER.md", "a/b/c/RULES.md/z"]
    folders = ["a", "a/b", "a/b/c/", "", "/", "/x", "/x/y/z", "/x/yy"]
    tables = spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(f,) for f in folders] * 2, "folder string")
    found = {r.folder: (r.source, r.path) for r in resolve_all(tables[1], tables[0]).collect()}
    local = lambda p: ("project-local", p)
    assert found == {
        "a": local("RULES.md"), "a/b": local("a/b/RULES.md"), "a/b/c/": local("a/b/RULES.md"), "": local("RULES.md"), "/": local("/RULES.md"), "/x": local("/RULES.md"), "/x/y/z": local("/x/y/RULES.md"), "/x/yy": local("/RULES.md"),
    }
    none = tables[0].where("path = 'none'")
    assert {(r.source, r.path) for r in resolve_all(tables[1], none).collect()} == {(None, None)}
    assert {(r.source, r.path) for r in resolve_all(tables[1], none, bundle="/b").collect()} == {("package-bundle", "/b")}


def test_version_rewrites(spark):
    from inkstone.sources.versions import rewrite

    rows = [("a.md", 'v1.0 "1.0" k@1.0 // 1.0 1.0 v1.0.1'), ("b.txt", "v1.0"), ("CHANGELOG.md", "v1.0"), ("c.py", None), ("c.py", "v1.0 v1.0")]
    files = spark.createDataFrame(rows, "path string, text string")
    required = spark.createDataFrame([("c.py", 1), ("c.py", 2), ("a.md", 1)], "path string, least long")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(rewrite(files, "1.0", "2.0", "k", required)) == sorted([
        ("a.md", 5, "updated", 'v2.0 "2.0" k@2.0 // 2.0 1.0 v2.0.1'), ("b.txt", 0, "skipped", "v1.0"), ("CHANGELOG.md", 0, "skipped", "v1.0"), ("c.py", 0, "short", ""), ("c.py", 2, "updated", "v2.0 v2.0"),
    ])
    checked = rewrite(files, "1.0", "2.0", "k", check=True)
    assert {r.state for r in checked.collect()} == {"stale", "skipped", "unchanged"} and checked.where("text like '%2.0%'").count() == 0
    assert rewrite(files.limit(0), "1.0", "2.0", "k").collect() == []


def test_dates_and_runners_come_from_the_data(spark):
    from inkstone.operators import scorecard as sc
    from inkstone.sources.benchmark import matrix_lines, render_scorecards

    counts = spark.createDataFrame([("m", "t", 1, "baseline", "RULE-B", 2), ("k", "t", 1, "treatment", "RULE-B", 3)], "runner string, task string, generation int, condition string, rule string, n long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Pacific/Auckland", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", name)
            cards = render_scorecards(counts, "1.0", 2, F.timestamp_seconds(F.lit(1_700_000_000))).collect()
            assert all("- Date: 2023-11-14\n" in c.text for c in cards)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert all("- Date: today\n" in c.text for c in render_scorecards(counts, "1.0", 2, "today").collect())
    assert sc.matrix(sc.rule_rows(counts)).columns == ["rule", "k", "m"]
    assert [r.line for r in matrix_lines(counts).where("part = 2").collect()] == ["| RULE-B | +3 | -2 |"]
    with pytest.raises(ValueError, match="runners"):
        sc.matrix(sc.rule_rows(counts), most=1)
    assert sc.runners_of(sc.rule_rows(counts.limit(0))) == []
