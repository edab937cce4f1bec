import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, most=2000):
    counts, sums = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sums[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    found = {}
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1000 * a * sums[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:most], 1):
            found[lang, rank] = (phrase.decode(), -a, l, r, sums[lang], -score)
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["a", "b", "Cc", "Éd", "e", "f\x00"]
    gap = [" ", " ", "  ", "\t", ", ", "\n", " . "]
    made = [(k, "".join(rng.choice(words) + rng.choice(gap) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None])) for k in range(60)]
    return made + [(1, "a b Cc a b Cc " * 40, "en")] * 2 + [(None, None, "en"), (None, "", None), (70, " \t.,;", "fr"), (71, "x" * 50_000 + " a b", "en")]


def collected(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"told": 0}, {"block": 7}, {"block": 7, "told": 0}, {"most": 5}])
def test_brute_force(spark, rows, options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1)).withColumn("doc", F.lit(1))
    want = brute(rows, 9, options.get("most", 2000))
    assert len(want) > 10
    assert collected(phrases.mine(table, least=9, **options)) == want


def test_empty_tables(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.mine(spark.createDataFrame([(1, "", None)], SCHEMA)).collect() == []


def test_exact_scores(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.randrange(100, 10**12)
        heads, tails = [sorted((rng.randrange(a, 10**13) for _ in range(3)), reverse=True) + [a] for _ in range(2)]
        rows.append((heads, tails[:3] + [a], a, rng.randrange(10**14, 10**15)))
    table = spark.createDataFrame(rows, "heads array<long>, tails array<long>, n long, words long")
    found = table.select(phrases.best_cut(F.col("heads"), F.col("tails"), F.col("n"), F.col("words")).alias("c")).collect()
    for (heads, tails, a, words), r in zip(rows, found, strict=True):
        assert tuple(r.c) == min((1000 * a * words // (heads[k - 1] * tails[3 - k]), k, heads[k - 1], tails[3 - k]) for k in range(1, 4))


def test_lookup_takes_another_mix_for_equal_ones():
    odd = np.uint64(0x9E3779B97F4A7C15)
    a = np.array([0, 1], np.int64)
    b = np.array([int(odd) - (1 << 64), 0], np.int64)  # both mixes are the odd number
    known, ids = phrases.Lookup(a, b, np.array([5, 6])).find(np.array([1, 0, 2]), np.array([0, int(b[0]), 0]))
    assert known.tolist() == [True, True, False]
    assert ids.tolist() == [6, 5]


def test_words_with_one_hash_take_another_seed(spark, rows, monkeypatch):
    """The first count names one hash for every word."""
    true, seeds = phrases.count_words, []

    def clashing(texts, seed, **more):
        seeds.append(seed)
        words = true(texts, seed, **more)
        return words.withColumn("h", F.lit(1).cast("long")) if seed == 0 else words

    monkeypatch.setattr(phrases, "count_words", clashing)
    assert collected(phrases.mine(spark.createDataFrame(rows, SCHEMA), least=9)) == brute(rows, 9)
    assert seeds == [0, 1]


def test_tasks_get_and_give_small_batches(spark, monkeypatch):
    """A batch of 10,000 rows was held whole by the executor and again by its worker, in both directions."""
    words = " ".join(f"w{k % 4000}" for k in range(100))
    table = spark.createDataFrame([(k, words, "en") for k in range(1000)], SCHEMA).coalesce(1)
    true, seen = phrases.slices, spark.sparkContext.accumulator(0)

    def watched(batches, **more):
        for batch in batches:
            if batch.num_rows > phrases.BATCH:
                seen.add(1)
            yield from true(iter([batch]), **more)

    monkeypatch.setattr(phrases, "slices", watched)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    assert phrases.mine(table, least=1000).count() == 96  # the phrases of five words
    assert seen.value == 0
    assert spark.conf.get(key, None) == before
