import re

from pyspark.sql import functions as F

from inkstone.operators.audit import audit, canonical_json, compare, human_report, rule_results, violations
from inkstone.operators.structure import lines_of, with_structure


def found(spark, text, **options):
    """Violations of one text as (rule, line, column, excerpt, detail)."""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.rule, r.line, r.column, r.excerpt, r.detail) for r in violations(audit(docs, **options)).orderBy("rule", "ordinal").collect()]


LINES = ["", "a", "a\n", "\n", "a\r\nb\rc\x1cd e\x85f\x0bg", "```\nx\n```\ny", "~~~\nx\n```", "a\n\n```py\n```\n\n```\nend", "  ```\n\x1f~~~ z\n", "```\n```\n```", "x```\n\n", "```", "\n```\n\n```\n"]


def slow_lines(text):
    out, open_ = [], False
    for n, line in enumerate(text.splitlines(), 1):
        marker = bool(re.match(r"\s*(```|~~~)", line))
        if marker:
            open_ = not open_
        out.append((line, n, open_, marker or open_))
    return out


def test_lines_and_fences(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "i int, text string")
    for r in docs.select("i", lines_of(F.col("text")).alias("lines")).collect():
        assert [(x.line, x.n, x.hidden, x.fenced) for x in r.lines] == slow_lines(LINES[r.i]), LINES[r.i]


def test_null_and_empty_texts_keep_24_results(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = rule_results(audit(docs)).collect()
    assert len(rows) == 48 and sum(r["count"] for r in rows) == 0
    assert sum(r.status == "skipped" for r in rows) == 28
    assert sum(r.status == "skipped" for r in rule_results(audit(docs, mechanical_only=True)).collect()) == 34


CASES = [
    ("a — b – c", [("RULE-B", 1, 3), ("RULE-B", 1, 7)]),
    ("2022–2026, a–b, 1—2", [("RULE-B", 1, 13), ("RULE-B", 1, 18)]),
    ("`a — b` — `c", [("RULE-B", 1, 9)]),
    ("😀 — x", [("RULE-B", 1, 3)]),
    ("~~~\n— x\n~~~ — y\nz — w", [("RULE-B", 3, 5), ("RULE-B", 4, 3)]),
    ("Moreover, x\n> - Additionally y\nso furthermore\nIn additional z\nmoreover-so", [("RULE-D", 1, 1), ("RULE-D", 2, 5), ("RULE-D", 4, 1)]),
    ("  In addition, x", [("RULE-D", 1, 3)]),
    ("# A Title of Things\n## bad Title\n# Wrong The Word\n# Well-known Facts\n# Trailing the", [("RULE-G", 2, 1), ("RULE-G", 3, 1), ("RULE-G", 4, 1), ("RULE-G", 5, 1)]),
    ("# [bad link](u) `code` Here ##", [("RULE-G", 1, 1)]),
    ("it's John's don’t naïve's `isn't` WE'LL", [("RULE-I", 1, 1), ("RULE-I", 1, 6), ("RULE-I", 1, 35)]),
    ("a novelty and a novel approach", [("RULE-05", 1, 1), ("RULE-05", 1, 15), ("RULE-05", 1, 17)]),
    ("Deep Dive; advance the state of the art", [("RULE-05", 1, 1), ("RULE-05", 1, 24), ("RULE-05", 1, 12)]),
    ("vast vasté delves DELVE leveraging leverage's", [("RULE-06", 1, 1), ("RULE-06", 1, 19), ("RULE-06", 1, 25), ("RULE-06", 1, 36), ("RULE-I", 1, 36)]),
    ("- one\n- two", [("RULE-A", 1, 1)]),
    ("1. a\n2. b\n3. c", [("RULE-A", 1, 1)]),
    ("- a\n- b\n- one two three four five six seven eight nine", []),
    ("- a\n\n- b\ntext", [("RULE-A", 1, 1), ("RULE-A", 3, 1)]),
    ("The cat. A dog. The end.", [("RULE-C", 1, 1)]),
    ("\n\nOne. Two two.\nThree x. Two y.", [("RULE-C", 3, 1)]),
    ("x\n\nFirst. Second thing.\nOverall, done.", [("RULE-E", 4, 1)]),
    ("These results represent progress.", [("RULE-E", 1, 1)]),
    ("> Overall, quoted.", []),
]


def test_places(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {i: [] for i in range(len(CASES))}
    for r in violations(audit(docs)).orderBy("doc_id", "rule", "ordinal").collect():
        got[r.doc_id].append((r.rule, r.line, r.column))
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_long_sentences_and_details(spark):
    words = " ".join(["word"] * 31)
    assert found(spark, f"{words}. Short one.\n# {words}\n| {words}")[0] == ("RULE-12", 1, 1, (words + ".")[:120].strip() + "…", "sentence length 31 words (>30)")
    assert len(found(spark, f"{words}. Short one.\n# {words}\n| {words}", mechanical_only=True)) == 2  # and the heading's case
    got = found(spark, "x" * 30 + " — " + "y" * 130)
    assert got[0][3] == "…" + ("x" * 19 + " — " + "y" * 98) + "…" and got[0][4] == "em-dash as casual punctuation"
    assert found(spark, "# the end")[0][4] == "heading not in title case; violating tokens: the, end"
    assert found(spark, "- a")[0][4] == "list has only 1 item(s); consider prose"
    assert found(spark, "- a\n- b\n- c")[0][4] == "list has 3 items all ≤ 8 words; consider prose"
    assert found(spark, "A b. B c. A d.")[0][3:] == ("A b.", "consecutive sentences start with 'a'")


def test_paragraphs_and_sentences(spark):
    docs = spark.createDataFrame([(1, "a b. C d!\n  e\n# h\nf\n| t\n\n> q\ng? (X) y")], "doc_id long, text string")
    paras = with_structure(docs).first().paras
    assert [(p.start, p.n_lines, p.sentences, p.firsts) for p in paras] == [
        (1, 2, ["a b.", "C d! e"], ["a", "c"]), (4, 1, ["f"], ["f"]), (8, 1, ["g?", "(X) y"], ["g", ""]),
    ]


def test_compare_counts_missing_sides_as_zero(spark):
    a = spark.createDataFrame([(1, "it's — x"), (2, "plain")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "it is — x"), (3, "isn't")], "doc_id long, text string")
    got = {(r.doc_id, r.rule): (r.a, r.b, r.delta) for r in compare(a, b).collect()}
    assert len(got) == 63 and got[1, "RULE-I"] == (1, 0, -1) and got[1, "RULE-B"] == (1, 1, 0) and got[3, "RULE-I"] == (0, 1, 1)


def test_reports(spark):
    docs = spark.createDataFrame([(1, "it's\n" * 7)], "doc_id long, text string")
    audited = audit(docs)
    text = human_report(audited, F.lit("f.md")).first().report
    assert text.startswith("review f.md: 7 violation(s)\n  RULE-I [low, mechanical]: 7\n    L1:C1  contraction 'it's'\n")
    assert text.count("    L") == 5 and text.endswith("  (14 rule(s) skipped; they need a judge)\n")
    import json

    got = canonical_json(audited, F.lit("f.md")).first().review_json
    assert got == json.dumps(json.loads(got), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert json.loads(got)["total_violations"] == 7 and len(json.loads(got)["rule_results"]) == 24


def test_a_line_of_very_many_matches(spark):
    import time

    from inkstone.operators.audit import audit

    docs = spark.createDataFrame([(1, "don't " * 10_000)], "doc_id long, text string")
    began = time.time()
    assert audit(docs).first().total_violations >= 10_000
    assert time.time() - began < 60


def test_places_equal_plain_search(spark):
    import re

    from pyspark.sql import functions as F

    from inkstone.functions.chars import find_all, find_overlapping

    texts = ["", "ab", "a" * 300, "`a` a `a", "😀a`é" * 150, "xx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(find_all(F.col("t"), "a").alias("x"), find_overlapping(F.col("t"), "a").alias("y")).collect()
    for t, r in zip(texts, rows, strict=True):
        want = [(m.start() + 1, "a", t[: m.start()].count("`") % 2 == 1) for m in re.finditer("a", t)]
        assert [tuple(v) for v in r.x] == want == [tuple(v) for v in r.y]


def test_columns_of_the_caller_are_kept(spark):
    from inkstone.operators.audit import audit

    docs = spark.createDataFrame([(1, 7, "p", 2.5, "It's."), (1, 7, "p", 2.5, "It's."), (2, None, None, None, None)], "doc_id long, lines int, paras string, `__RULE-B` double, text string")
    got = audit(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lines, r.paras, r["__RULE-B"], r.total_violations) for r in got] == [(1, 7, "p", 2.5, 1), (1, 7, "p", 2.5, 1), (2, None, None, None, 0)]
    assert audit(docs.limit(0)).count() == 0


def test_overlapping_phrases_and_their_tree(spark):
    import re

    from pyspark.sql import functions as F

    from inkstone.functions.chars import any_of, find_overlapping
    from inkstone.operators.detectors import CLICHES, JARGON

    for words in (CLICHES, JARGON, ["a", "ab", "abc", "b.c", "b"]):
        tree = re.compile(any_of(words))
        assert all(tree.fullmatch(w) for w in words)
        assert not any(tree.fullmatch(w + "x") or tree.fullmatch(w[1:]) for w in words if w + "x" not in words and w[1:] not in words)
    assert not any(a != b and a.startswith(b) for a in CLICHES for b in CLICHES)
    texts = ["aba", "xaba`aba aba`ab", "ababa", "", "`", "bab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(find_overlapping(F.col("t"), any_of(["aba", "ba"])).alias("x")).collect()
    for t, r in zip(texts, rows, strict=True):
        want = [(m.start() + 1, m[1], t[: m.start()].count("`") % 2 == 1) for m in re.finditer("(?=(aba|ba))", t)]
        assert [tuple(v) for v in r.x] == want


def test_counts_equal_what_is_told(spark):
    from inkstone.operators.audit import audit, rule_results

    text = (
        "# a bad Heading\n\nAdditionally, we `delve` delve — it's a novel approach, at the end of the day.\n" + "word " * 31 + ". Short.\n\nThe a. The b. The c. In summary, it is `so it's`\n\n"
        "- one\n- two `—` – x\n\n```\nit's — code\n```\n> Moreover, state of the art, advance the state of the art.\n"
    )
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text * 3)], "doc_id long, text string")
    keep = ["doc_id", "place", "rule", "severity", "detector", "status", "count", "note"]
    key = lambda rows: sorted(map(tuple, rows.select(*keep).collect()))
    for options in ({}, {"mechanical_only": True}, {"rules": ["RULE-B", "RULE-05", "RULE-01"]}):
        told, counted = rule_results(audit(docs, **options)), rule_results(audit(docs, counts_only=True, **options))
        assert "violations" not in counted.columns and key(told) == key(counted)
    assert {r[2] for r in key(told)} == {"RULE-B", "RULE-05", "RULE-01"}
    assert sum(r[6] for r in key(rule_results(audit(docs)))) > 40


def test_what_is_not_asked_for_is_not_in_the_plan(spark):
    from inkstone.operators.audit import audit, rule_results

    docs = spark.createDataFrame([(1, "We delve.")], "doc_id long, text string")
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    marks = {"RULE-B": "em", "RULE-D": "transition opener", "RULE-06": "AI-tell", "RULE-A": "list has", "RULE-C": "consecutive sentences"}
    one = plan(rule_results(audit(docs, rules=["RULE-06"])))
    assert marks["RULE-06"] in one and not any(m in one for r, m in marks.items() if r not in ("RULE-06", "RULE-B"))
    none = plan(rule_results(audit(docs, skipped_only=True)))
    assert not any(m in none for r, m in marks.items() if r != "RULE-B") and "__text" not in none
    assert {r.status for r in rule_results(audit(docs, skipped_only=True)).collect()} == {"skipped"}
