"""Lines of a megabyte that are made to be slow: every detector takes time in proportion to them."""

import time

import pytest
from pyspark.sql import functions as F

from inkstone.functions.chars import WS_CHARS, strip, word_count
from inkstone.operators import audit as au
from inkstone.operators.detectors import heading_text

MB = 1_000_000
HOSTILE = {
    "marks": "> " * (MB // 2) + "Moreover, x",
    "bullets": "* " * (MB // 2) + "Moreover, x",
    "hyphens": "-" * MB,
    "apostrophes": "a" + "'" * MB,
    "blanks": "a" + " " * MB + "b",
    "heading": "# a" + " " * MB + "b",
    "hashes": "# a " + "#" * MB + "b",
    "letters": "a" * MB,
    "ends": ". " * (MB // 2),
    "brackets": "# " + "[" * MB,
}


def test_white_space_is_that_of_the_language():
    assert list(WS_CHARS) == [c for c in map(chr, range(0x3001)) if c.isspace()]


@pytest.mark.parametrize("name", HOSTILE)
def test_audit_of_a_long_line(spark, name):
    table = lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string")
    au.audit(table("warm up")).collect()
    began = time.time()
    found = {r.rule: r["count"] for r in au.rule_results(au.audit(table(HOSTILE[name]))).where("status = 'violation'").collect()}
    assert time.time() - began < 20
    assert found.get("RULE-D", 0) == (name in ("marks", "bullets"))


def test_primitives_in_time(spark):
    lines = spark.createDataFrame([(n, x) for n, x in HOSTILE.items()], "name string, x string").repartition(1).cache()
    lines.count()
    for use in (strip, word_count, heading_text):
        began = time.time()
        lines.select(F.sum(F.xxhash64(use(F.col("x")).cast("string")).cast("decimal(38,0)"))).collect()
        assert time.time() - began < 5  # ten lines


def test_what_they_give(spark):
    cases = {
        "# Title": "Title", "  ## Two  ##  ": "Two", "# a ## b ##": "a ## b", "# a##": "a##", "# ###": "###", "#\t": "", "# a #  ": "a", "###### six": "six", "# ": "", "#   ### x": "### x",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", heading_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == cases
    counts = {"a-b c's 'd' -- ' e": 4, "--'--": 0, "-x-y": 1, "": 0, "é_1 2": 2, "a--'--b": 1}
    rows = spark.createDataFrame([(k,) for k in counts], "x string").select("x", word_count(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == counts
