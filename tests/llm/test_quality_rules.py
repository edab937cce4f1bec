import re
import time
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkstone.llm import quality_rules as qr

SPACE = " \t\n\x0b\x0c\r"


def slow_measures(text):
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    return (
        len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat),
        len(words) < 50 or 100 * len(repeat) > 50 * len(words),
    )


CLEAN = "The quick%d brown%d fox, number %d, jumps over%d a lazy%d dog near%d the old%d river bank%d.\n"
TEXTS = {
    1: None,
    2: "",
    3: " \t\x0b\x0c\r\n ",
    4: "".join(CLEAN.replace("%d", str(i)) for i in range(6)),
    5: "".join(CLEAN.replace("%d", str(i)) for i in range(6)) + "\nHome | About | News | Contact\nAll rights reserved.\n",
    6: "Und " * 100,
    7: "a b c a b c d e f a b",
    8: "x\n\nx\n y\n y\n\n",
    9: "WORDS!! " * 30 + "".join(f"w{i}*** " for i in range(90)),
    10: "\xa0é😀 " * 3 + "  ß|<>",
    11: " ".join(f"word{i}" for i in range(60_000)),
    12: "".join(CLEAN.replace("%d", str(i)) for i in range(4)) + "".join(f"item{i} | " for i in range(400)),
    13: " ".join(f"w{i % 997}." for i in range(30_000)),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", 7) for i, t in TEXTS.items()] + [(4, TEXTS[4], "a", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, n_chars int")


def test_measures_equal_brute_force(docs):
    rows = qr.measure(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == slow_measures(TEXTS[r.doc_id] or ""), r.doc_id


def test_verdicts(docs):
    kept = {r.doc_id: r.kept for r in qr.measure(docs).collect()}
    assert {i for i, k in kept.items() if k} == {4, 5}
    clean = {r.doc_id: r.clean_text for r in qr.measure(docs).collect()}
    assert "About" not in clean[5] and "rights" not in clean[5] and clean[4] == TEXTS[4]


def test_apply_keeps_columns_and_cleans(docs):
    got = qr.apply(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == {4, 5} and got.count() == 3
    assert rows[5].n_chars == len(rows[5].text) and rows[5].words == "a" and "About" not in rows[5].text


def test_empty_table(docs):
    assert qr.measure(docs.limit(0)).count() == 0 and qr.apply(docs.limit(0)).count() == 0


def test_sql_gives_the_same_rows(docs):
    con = duckdb.connect()
    documents = pd.DataFrame({"doc_id": list(TEXTS), "text": list(TEXTS.values())})
    con.register("documents", documents)
    cursor = con.execute(qr.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    want = {tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()}
    got = {tuple(r[c] for c in sorted(names)) for r in qr.measure(docs).drop("clean_text").collect()}
    assert got == want


def test_plan_has_no_python_and_no_shuffle(docs):
    plan = qr.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_words_of_a_megabyte_take_linear_time(spark):
    texts = {"letters": "a" * 1_000_000, "marks": "#!" * 500_000, "ends": ".'" * 500_000, "noisy": "a" * 999_990 + "!! b"}
    table = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(1).cache()
    table.count()
    qr.measure(table.limit(0)).collect()
    began = time.time()
    found = {r.doc_id: r.clean_text for r in qr.measure(table).select("doc_id", "clean_text").collect()}
    assert time.time() - began < 4 * len(texts)
    assert found == {**texts, "noisy": ""}


def test_noisy_words_are_counted_once(spark):
    cases = {"a!!b!!c d": 1, "###": 1, "##": 0, "x$%&y !! z": 2, "": 0, "!!\t!! a#": 2}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in rows.select("t", F.regexp_count("t", F.lit(qr.NOISY_WORD)).alias("n")).collect()} == cases
