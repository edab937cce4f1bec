import json

import pytest
from pyspark.sql import functions as F

from inkstone.functions import canon
from inkstone.operators import scorecard as sc
from inkstone.sources import benchmark, documents, registry, rulepack
from inkstone.streaming import audits

PACK = """<!-- note -->
# Pack

Intro.

#### RULE-01: First Rule \n
- **severity**: Critical
- **scope**: all

##### Directive

Do it.

##### BAD → GOOD

- BAD: worse
- GOOD: better
- BAD: more

##### Rationale for AI Agent

Because.

#### RULE-A: Second
- **source**: book

##### Directive
Do that.
##### BAD → GOOD
- BAD (x): one
- GOOD (y): two
"""


def frame(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))


def test_rule_pack(spark):
    rows = rulepack.parse(frame(spark, file="f", text=PACK)).collect()
    assert [(r.ord, r.rule, r.title, r.severity, r.scope, r.source, r.directive, r.rationale) for r in rows] == [
        (1, "RULE-01", "First Rule", "critical", "all", "", "Do it.", "Because."), (2, "RULE-A", "Second", "", "", "book", "Do that.", ""),
    ]
    short = rulepack.compact(frame(spark, file="f", text=PACK))
    checked = rulepack.check_compact(short, rules=2).first()
    assert checked.problems == [] and "Because" not in checked.compact and "- BAD: more" not in checked.compact
    assert "number of rules" in rulepack.check_compact(short).first().problems
    assert rulepack.parse(frame(spark, file="f", text="nothing")).count() == 0
    assert rulepack.check_depth(frame(spark, file="f", text=PACK), 2).first().complete is False
    both = frame(spark, a="x\n# T\nb", b="yy\n# T\nb").select(rulepack.same_tail(F.col("a"), F.col("b")), rulepack.refresh_alias(F.col("a"), F.lit("q\n# New\nz"))).first()
    assert both[0] and both[1] == "x\n# New\nz"


def test_resolving_a_pack(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    bundle = tmp_path / "bundle.md"
    bundle.write_text("x")
    assert rulepack.resolve(str(tmp_path / "a/b"), "NO-SUCH.md", str(bundle)) == ("package-bundle", str(bundle))
    (tmp_path / "a/RULES.md").write_text("y")
    assert rulepack.resolve(str(tmp_path / "a/b")) == ("project-local", str((tmp_path / "a/RULES.md").resolve()))
    with pytest.raises(FileNotFoundError):
        rulepack.resolve(str(tmp_path / "a/b"), "NO-SUCH.md")


def test_texts_and_drafts(spark, tmp_path):
    for name, text in {"r1/t-x-baseline/draft-1.md": "it's\r\nx", "r1/t-x-treatment/draft-2.md": "fine"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    rows = {(r.runner, r.task, r.condition, r.generation, r.text) for r in documents.read_drafts(spark, str(tmp_path)).collect()}
    assert rows == {("r1", "t-x", "baseline", 1, "it's\nx"), ("r1", "t-x", "treatment", 2, "fine")}
    assert documents.read_tree(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception):
        documents.read_texts(spark, str(tmp_path / "none")).collect()
    assert frame(spark, t="a\r\nb").select(documents.normalised_source(F.col("t"))).first()[0] == "a\nb\n"
    with pytest.raises(Exception):
        frame(spark, t="﻿a").select(documents.normalised_source(F.col("t"))).collect()
    documents.write_texts(frame(spark, text="a\r\nb\n\n"), str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part*")) == b"a\nb\n"


COUNTS = [
    ("r1", "t1", 1, "baseline", "RULE-B", 3), ("r1", "t1", 1, "treatment", "RULE-B", 1), ("r1", "t1", 1, "baseline", "RULE-12", 2), ("r1", "t1", 1, "treatment", "RULE-12", 0),
    ("r1", "t1", 2, "treatment", "RULE-G", 9), ("r1", "t2", 1, "baseline", "RULE-I", 0), ("r1", "t2", 1, "treatment", "RULE-I", 2), ("r2", "t1", 1, "baseline", "RULE-B", 0), ("r2", "t1", 1, "treatment", "RULE-B", 0),
]


def test_scorecards(spark):
    counts = spark.createDataFrame(COUNTS, "runner string, task string, generation int, condition string, rule string, n long")
    rows = {(r.runner, r.task): (r.baseline, r.treatment, r.delta, r.dominant) for r in sc.task_rows(counts).collect()}
    assert rows == {("r1", "t1"): (5, 10, 5, "RULE-12"), ("r1", "t2"): (0, 2, 2, "RULE-I"), ("r2", "t1"): (0, 0, 0, "—")}
    assert {r.runner: r.pct for r in sc.total_rows(counts).collect()} == {"r1": "+140%", "r2": "n/a"}
    cards = benchmark.render_scorecards(counts, "1", 2)
    text = {r.file: r.text for r in cards.collect()}["r1.md"]
    assert "| t1 | 5 | 10 | 5 | RULE-12 |\n| t2 | 0 | 2 | 2 | RULE-I |\n" in text and "| total violations | 5 | 12 | 7 |" in text
    back = {(r.runner, r.rule): (r.delta, r.total_treatment) for r in benchmark.scan_scorecards(cards).collect()}
    assert back == {("r1", "RULE-12"): (-2, 12), ("r1", "RULE-B"): (-2, 12), ("r1", "RULE-G"): (9, 12), ("r1", "RULE-I"): (2, 12)}
    for broken in (text.replace("total violations", "total"), text.replace("## Per-rule aggregate", "## Other"), text.replace("| RULE-", "| X-")):
        with pytest.raises(Exception):
            benchmark.scan_scorecards(frame(spark, file="x.md", text=broken)).collect()
    whole = benchmark.render_matrix(counts, ["r1", "r2"], "1").first().text
    assert "| r1 | 5 | 12 | +7 | +140% |" in whole and "| RULE-B | -2 | 0 |" in whole
    assert {r.runner: r.complete for r in sc.completeness(counts, 2).collect()} == {"r1": True, "r2": False}


@pytest.mark.parametrize(("b", "t", "want"), [(8, 9, "+12%"), (200, 203, "+2%"), (200, 201, "+0%"), (200, 199, "-0%"), (105, 58, "-45%"), (61, 63, "+3%"), (79, 14, "-82%"), (0, 3, "n/a"), (4, 4, "+0%")])
def test_percent_rounds_half_to_even(spark, b, t, want):
    row = spark.createDataFrame([(b, t - b)], "b long, d long").select(sc.percent(F.col("b"), F.col("d"))).first()[0]
    assert row == want == ("n/a" if b == 0 else f"{100 * (t - b) / b:+.0f}%")


def test_tasks(spark):
    text = 'x\n<task id="a-1">\n<prompt>\nline 1\nline 2\n</prompt>\n</task>\n<task id="b">\n<prompt>\nq\n</prompt>\n</task>\n'
    assert [(r.task, r.prompt) for r in benchmark.scan_tasks(frame(spark, file="f", text=text)).collect()] == [("a-1", "line 1\nline 2"), ("b", "q")]


def test_signatures_and_blocks(spark):
    one = lambda text, column: frame(spark, t=text).select(column(F.col("t"))).first()[0]
    signed = one("a\r\nb\n\n\n", lambda t: canon.sign(t, "1.0"))
    assert one(signed, canon.verify) == "valid" and one("x" + signed, canon.verify) == "mismatch" and one("a", canon.verify) == "unsigned"
    assert one(signed, lambda t: canon.sign(t, "1.0")) == signed
    made = one("a", lambda t: canon.upsert_block(t, "1", F.lit("\nbody\n")))
    assert (made.text, made.action) == ("a\n\n<!-- BEGIN inkstone v1 -->\nbody\n<!-- END inkstone -->\n", "create")
    again = one(made.text, lambda t: canon.upsert_block(t, "2", F.lit("new $1")))
    assert again.action == "update-marker" and "v2 -->\nnew $1\n<!-- END" in again.text
    assert one(again.text, lambda t: canon.remove_block(t)) == ("a", "remove-marker")
    assert one("<!-- END inkstone --><!-- BEGIN inkstone -->", canon.block_state) == "ambiguous" and one("", canon.block_state) == "none"
    assert one(".\\a\\b", canon.posix_path) == "a/b"


def test_registry(spark, tmp_path):
    path = tmp_path / "tools.json"
    path.write_text(json.dumps({"schema_version": 1, "tools": [{"name": "a", "install_mode": "print-only", "target_path": "x"}, {"name": "b", "install_mode": "owned-file", "adapter_source": "s"}]}))
    tools = registry.read_tools(spark, str(path))
    got = {r.name: (r.missing, r.unwanted) for r in registry.check_tools(tools, {"owned-file": ["target_path"]}, {"print-only": ["target_path"]}).collect()}
    assert got == {"a": ([], ["target_path"]), "b": (["target_path"], [])}
    path.write_text(json.dumps({"schema_version": 2, "tools": []}))
    with pytest.raises(Exception):
        registry.read_tools(spark, str(path)).collect()
    plan = spark.createDataFrame([("p", 2, "write", "b", None, "h"), ("p", 1, "write", "a", None, "g")], "plan string, order int, op string, path string, content_sha256_before string, content_sha256_after string")
    assert [x["path"] for x in json.loads(registry.actions_json(plan).first().actions_json)] == ["a", "b"]


def test_stream_audits_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    go = lambda: audits.write_results(audits.audit_stream(audits.text_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    (tmp_path / "in/a.md").write_text("it's — x")
    go()
    (tmp_path / "in/b.md").write_text("don't")
    go()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 48
    assert {r["rule"]: r["n"] for r in rows.groupBy("rule").agg(F.sum("count").alias("n")).where("n > 0").collect()} == {"RULE-B": 1, "RULE-I": 2}


def test_coverage_of_tools_without_cover(spark):
    from inkstone.sources import registry

    targets = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", ["w"])], "tool string, active array<string>")
    covered = spark.createDataFrame([("a", ["y", "q"]), ("c", None)], "tool string, covered array<string>")
    got = {r.tool: (r.active, r.served, r.uncovered) for r in registry.coverage(targets, covered).collect()}
    assert got == {"a": ("x,y", "y", "x"), "b": ("z", "", "z"), "c": ("w", "", "w")}


def test_prompts_are_the_lines_between_the_marks(spark):
    from inkstone.sources import benchmark

    text = '<task id="a">\n<prompt>\none\n\ntwo\n  </prompt>\n</task>\n<task id="b">\n<prompt>\n</prompt>\n</task>\n<task id="c">\n<prompt>\n' + "w " * 100_000 + "\n</prompt>\n</task>\n"
    got = {r.task: r.prompt for r in benchmark.scan_tasks(spark.createDataFrame([("f", text)], "file string, text string")).collect()}
    assert got == {"a": "one\n\ntwo", "b": "", "c": "w " * 100_000}


FENCED = """pre
# Pack

Intro.

## Part

Stays.

```
#### RULE-77: in a fence
- BAD: no
```

#### RULE-01: One
- **severity**: low

##### BAD → GOOD

- GOOD: early
```
- BAD: fenced
```
- BAD: one
  more

- GOOD: two
```
- BAD: inside
```

- GOOD: three

##### Directive

Do.


### Between

Stays too.

#### Other

#### RULE-A: Two
##### Directive

Last."""


def test_compact_keeps_sections_and_the_first_complete_pair(spark):
    row = rulepack.compact(frame(spark, file="f", text=FENCED)).first()
    assert row.rules == 2 and row.errors == ["#### Other: no rule", "#### RULE-A: Two: no pair"]
    assert row.compact == (
        "pre\n# Pack\n\nIntro.\n\n## Part\n\nStays.\n\n```\n#### RULE-77: in a fence\n- BAD: no\n```\n\n#### RULE-01: One\n\n##### Directive\n\nDo.\n\n##### BAD → GOOD\n\n"
        "- BAD: one\n  more\n\n- GOOD: two\n```\n- BAD: inside\n```\n\n### Between\n\nStays too.\n\n#### Other\n\n#### RULE-A: Two\n\n##### Directive\n\nLast.\n"
    )
    assert rulepack.compact(frame(spark, file="f", text=FENCED), intro="Short.").first().compact.startswith("pre\n# Pack\n\nShort.\n\n## Part\n")
    found = [(r.line, r.level, r.title) for r in rulepack.headings(frame(spark, file="f", text="# A #\n\n```\n# no\n```\n  ##   B\n#no\n###\n")).orderBy("line").collect()]
    assert found == [(1, 1, "A"), (6, 2, "B"), (8, 3, "")]


def test_compact_of_odd_packs(spark):
    texts = [None, "", "no title", "```\n# open", "#### RULE-01: x\n##### BAD GOOD\n- GOOD: a\n" + "- BAD: b\n" * 20_000]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts + texts[:1])], "file int, text string, rules string")
    got = {r.file: (r.rules, r.errors) for r in rulepack.compact(rows).collect()}
    assert got == {0: (0, ["no title"]), 1: (0, ["no title"]), 2: (0, ["no title"]), 3: (0, ["no title"]), 4: (1, ["no title", "#### RULE-01: x: no directive", "#### RULE-01: x: no pair"]), 5: (0, ["no title"])}
    assert rulepack.compact(rows.limit(0)).count() == 0 == rulepack.headings(rows.limit(0)).count()


def test_compact_of_directives_without_text_and_with_noncharacters(spark):
    pack = "# Pack\n\n#### RULE-01: {0}\n\n##### Directive\n\n{0}\n\n##### BAD → GOOD\n\n- BAD: one\n- GOOD: two\n"
    texts = ["", "Do.", "x\ufdd0\ufdd1 0\ufdd10"]
    rows = spark.createDataFrame([(k, pack.format(t)) for k, t in enumerate(texts)] + [(9, pack.format("x\ufdd0").replace("- GOOD", "- OTHER"))], "file int, text string")
    got = {r.file: (r.compact, r.errors) for r in rulepack.compact(rows).collect()}
    assert {k: got[k] for k in range(3)} == {k: (pack.format(t), []) for k, t in enumerate(texts)}
    assert got[9][1] == ["#### RULE-01: x\ufdd0: no pair"]
    assert [r.title for r in rulepack.headings(rows.where("file = 2")).orderBy("line").collect()][1] == f"RULE-01: {texts[2]}"


def test_bytes_that_are_no_utf8_are_an_error(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"")
    (tmp_path / "b.md").write_bytes("ü\r\n".encode())
    assert sorted(r.text for r in documents.read_texts(spark, str(tmp_path)).collect()) == ["ü\n"]
    assert [r.file.rsplit("/", 1)[1] for r in documents.read_tree(spark, str(tmp_path), ordered=True).collect()] == ["b.md"]
    (tmp_path / "a.md").write_bytes(b"a\r")
    assert [r.file.rsplit("/", 1)[1] for r in documents.read_tree(spark, str(tmp_path), ordered=True).collect()] == ["a.md", "b.md"]
    (tmp_path / "c.md").write_bytes(b"a\xff")
    with pytest.raises(Exception, match="UTF8"):
        documents.read_texts(spark, str(tmp_path)).collect()


def test_matrix_with_the_detail_of_models(spark):
    counts = spark.createDataFrame(COUNTS, "runner string, task string, generation int, condition string, rule string, n long")
    cards = benchmark.render_scorecards(counts, "1", 2)
    text = benchmark.render_matrix(counts, ["r1", "r2"], "1", cards).first().text
    detail = text[text.index("<details>") : text.index("</details>")]
    assert "### r1\n\n- Runner: r1" in detail and "| t1 | 5 | 10 | 5 | RULE-12 |" in detail and detail.index("### r1") < detail.index("### r2") and "\n# " not in detail


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (None, None), ("{", "no JSON"), ("3", "no object"), ("{}", "entries is no list"), ('{"entries":null}', "entries is no list"), ('{"entries":[]}', None), ('{"entries":[null]}', "entry 0 is no object"),
        ('{"entries":[{"path":""}]}', "entry 0 has no path"), ('{"entries":[{"path":"a"}]}', "entry 0 has another kind than file"), ('{"entries":[{"path":"a","kind":"file","sha256":"0A"}]}', "entry 0 has no valid sha256"),
        ('{"entries":[{"path":"a","kind":"file","sha256":"%s"}, 1]}' % ("0a" * 32), "entry 1 is no object"), ('{"entries":[{"path":"a","kind":"file","sha256":"%s"}]}' % ("0a" * 32), None),
    ],
)
def test_faults_of_manifests(spark, text, error):
    assert registry.manifest_errors(spark.createDataFrame([("f", text)], "file string, text string")).first().error == error


def test_targets_and_outputs(spark):
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    targets = spark.createDataFrame([("t", "a/b"), ("t", "c/"), ("t", "d.md"), ("u", "e"), ("u", None)], "tool string, target_path string")
    got = registry.uncovered_targets(targets, paths("a/b/x.md", "a/bc", "c/y/z.md", "d.md", None), paths("a/bc", "c/q.md", "zz"))
    assert sorted(map(tuple, got.collect())) == [("t", "a/b"), ("t", "d.md")]
    assert registry.uncovered_targets(targets.limit(0), paths("a"), paths("a")).count() == 0
    texts = lambda *x: spark.createDataFrame(x, "path string, text string")
    states = registry.output_states(texts(("a", "x"), ("b", "x"), ("c", None), ("d", "")), texts(("a", "x"), ("b", "y"), ("d", None), ("e", "z")))
    assert {r.path: r.state for r in states.collect()} == {"a": "current", "b": "out of date", "c": "missing", "d": "current"}


def test_stream_refuses_bytes_that_are_no_text(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes(b"It's \xff")
    found = audits.audit_stream(audits.text_stream(spark, str(tmp_path / "in")))
    with pytest.raises(StreamingQueryException, match="UTF8"):
        audits.write_results(found, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()


def test_stream_of_repeated_and_empty_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.md", "It's — so."), ("b.md", "It's — so."), ("c.md", "")):
        (tmp_path / "in" / name).write_text(text)
    found = audits.audit_stream(audits.text_stream(spark, str(tmp_path / "in")))
    audits.write_results(found, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 48 and rows.where("count > 0").count() == 4


def test_scorecards_of_empty_repeated_and_dressed_tables(spark):
    from inkstone.operators import scorecard as sc
    from inkstone.sources import benchmark

    schema = "runner string, task string, generation int, condition string, text string, n int, rule string"
    rows = [("m", "t", 1, "baseline", "It's.", 9, "x")] * 2 + [("m", "t", 1, "treatment", None, 9, "x"), (None, None, None, "treatment", "", 9, "x")]
    counts = sc.draft_counts(spark.createDataFrame(rows, schema))
    assert [(r.runner, r.rule, r.baseline, r.treatment) for r in sc.rule_rows(counts).collect()] == [("m", "RULE-I", 2, 0)]
    none = sc.draft_counts(spark.createDataFrame([], schema))
    assert none.count() == sc.task_rows(none).count() == sc.rule_rows(none).count() == benchmark.render_scorecards(none, "1", 1).count() == 0


def test_canonical_forms_of_null_empty_and_very_long_texts(spark):
    from pyspark.sql import functions as F

    from inkstone.functions import canon

    long = "x" * 1_000_000 + "\n" * 1000
    rows = spark.createDataFrame([(0, None), (1, ""), (2, long), (2, long)], "k int, t string")
    found = rows.select("k", F.length(canon.canonical(F.col("t"))).alias("n"), canon.verify(F.col("t")).alias("v"), canon.verify(canon.sign(F.col("t"), "1")).alias("s")).orderBy("k").collect()
    assert [(r.k, r.n, r.v, r.s) for r in found[1:]] == [(1, 1, "unsigned", "valid"), (2, 1_000_001, "unsigned", "valid"), (2, 1_000_001, "unsigned", "valid")]
    assert found[0].n is None
