"""Counts without places: equal to what detectors tell, and read once by everything that is made from them."""

import random

import pytest
from pyspark.sql import functions as F

from inkstone.operators import scorecard as sc
from inkstone.operators.audit import audit, rule_results
from inkstone.sources import benchmark

PIECES = [
    "\n", "\n", " ", " ", ",", ". ", "? ", "!", "'", "-", "—", "–", "`", "#", "\n## ", "|", "\n> ", "\n* ", "1. ", "\n```\n", "\n~~~\n", "\r", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", " ", "\xa0", "　",
    "A", "é", "É", "1", "٣", "_", "(", "[", '"', "'s", "don't", "WE'LL", "ſ", "K", "İ", "ı", "Σ", "\U0001f600", "leverage", "Leverages", "KEEN", "vaſt", "utılize", "game-changing",
    "novel approach", "a novel", "State-of-the-Art", "next generationext generation", "DEEP DIVE", "circle bacK", "Moreover,", "moreover-x", "In addition", "in  addition", "furthermoreé", "the", "[x](y)",
    " ".join(["w"] * 14), ", ".join(["Ab"] * 16), "x " * 29, "é " * 30, "a-b'c",
]


def test_counts_of_odd_texts_equal_what_is_told(spark):
    dice = random.Random(7)
    texts = ["".join(dice.choice(PIECES) + dice.choice(["", "", " "]) for _ in range(dice.choice([3, 10, 40, 120]))) for _ in range(800)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id long, text string").repartition(4).cache()
    rows = lambda **how: {(r.doc_id, r.rule): r["count"] for r in rule_results(audit(docs, mechanical_only=True, **how)).where("detector = 'mechanical'").collect()}
    told, counted = rows(), rows(counts_only=True)
    assert told == counted and len(told) == 7 * len(texts) + 14
    assert all(sum(n for (_, r), n in told.items() if r == rule) > 30 for rule in {r for _, r in told})


def watched(rows):
    """``rows``, and how many of them have been read so far."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(tell, rows.schema), seen


@pytest.fixture
def counts(spark):
    rows = [(x, t, g, c, r, 3 * g + len(x + t + c + r) % 5) for x in ("aa", "b") for t in ("t1", "t22") for g in (1, 2) for c in ("baseline", "treatment") for r in ("RULE-A1", "RULE-B")]
    return spark.createDataFrame(rows, "runner string, task string, generation int, condition string, rule string, n long").coalesce(1)


def test_a_matrix_reads_its_rules_once(counts):
    rules = sc.rule_rows(counts).coalesce(1)
    given, seen = watched(rules)
    found = sc.matrix(given).collect()
    assert seen.value == rules.count() == 4 and found and {*found} == {*sc.matrix(rules, ["aa", "b"]).collect()}


def test_task_rows_read_counts_once(counts):
    given, seen = watched(counts)
    found = {(r.runner, r.task): (r.baseline, r.treatment, r.delta, r.dominant) for r in sc.task_rows(given).collect()}
    assert seen.value == 32 and len(found) == 4
    parts = sc.dominant_rules(counts).collect()
    assert {(r.runner, r.task): r.dominant for r in parts} == {k: v[3] for k, v in found.items()}
    assert sum(v[0] + v[1] for v in found.values()) == counts.agg(F.sum("n")).first()[0] and all(v[2] == v[1] - v[0] for v in found.values())


def test_matrix_lines_read_counts_once(counts):
    given, seen = watched(counts)
    lines = benchmark.matrix_lines(given)
    assert {*lines.collect()} == {*benchmark.matrix_lines(counts, ["aa", "b"]).collect()} and seen.value == 32


def test_a_rendered_matrix_reads_counts_once(counts):
    given, seen = watched(counts)
    text = benchmark.render_matrix(given, None, "1.0").first().text
    assert text == benchmark.render_matrix(counts, ["aa", "b"], "1.0").first().text and seen.value == 32


def test_scorecards_read_counts_once(counts):
    given, seen = watched(counts)
    cards = benchmark.render_scorecards(given, "1.0", 2)
    assert benchmark.scan_scorecards(cards).count() == 4 and seen.value == 32
