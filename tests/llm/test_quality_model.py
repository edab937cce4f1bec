import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import quality_model as qm


def sample_texts(n):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))]
        good = i % 3 > 0
        text = " ".join(words) + "." if good else " ".join(w + rng.choice(["***", "!!", "|"]) for w in words)
        rows.append((i, text, int(good)))
    return rows


def test_pooling_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        y, w = rng.uniform(size=8), rng.integers(1, 5, 8).astype(float)
        got = qm.pool(y, w)
        # min-max formula of isotonic regression
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 8)) for a in range(i + 1)) for i in range(8)]
        assert np.allclose(got, want)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    gamma, width = 0.08, 20_000
    m = qm.Model(np.zeros(16), np.ones(16), rng.normal(0, np.sqrt(2 * gamma), (16, width)), rng.uniform(0, 2 * np.pi, width), None, None, None)
    x = rng.normal(size=(6, 16))
    z = m.lift(x)[:, :-1]
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_partition_sums_give_the_direct_solution(spark):
    rows = sample_texts(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = qm.fit(qm.features(docs), labels, seed=7)
    use = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    ids = [r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) != 0).collect()]
    use = [(t, y) for i, t, y in rows if i in set(ids) and zlib.crc32(str(i).encode()) % 4 != 2]
    z = model.lift(np.array([qm.statistics(t) for t, _ in use]))
    want = np.linalg.solve(z.T @ z + 1e-3 * len(use) * np.eye(z.shape[1]), z.T @ np.array([y for _, y in use], float))
    assert np.allclose(model.weights, want, atol=1e-6)


def test_held_out_accuracy(spark):
    rows = sample_texts(900)
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(9000, None, "z"), (9001, "", "z"), (None, "a b c.", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(0, None, 0), (None, 1, 0), (9001, 1, 1)], "doc_id long, quality int, toxic int")
    got = qm.classify(docs, labels).collect()
    assert len(got) == 903
    truth = {i: y for i, _, y in rows}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    kept = qm.keep_good(docs, docs, labels)
    assert kept.columns == docs.columns
    assert np.mean([truth.get(r.doc_id, 1) for r in kept.collect()]) > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None)]])
def test_small_tables(spark, labels):
    docs = spark.createDataFrame([(1, "a b c."), (1, "a b c."), (2, "word " * 100_000)], "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    got = qm.classify(docs, given).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert qm.classify(docs.limit(0), given).count() == 0
