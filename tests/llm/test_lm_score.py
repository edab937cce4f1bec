import random
from collections import Counter

import numpy as np

from inkstone.llm import lm_score as lm


def corpus(n, seed=3):
    rng = random.Random(seed)
    subject, verb, thing = ["cat", "dog", "bird"], ["sees", "hears"], ["food", "water", "grass"]
    return [" ".join(f"the {rng.choice(subject)} {rng.choice(verb)} some {rng.choice(thing)} and" for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_counts_equal_brute_force(spark):
    texts = [*corpus(50), "", None, "unknownword X", "the " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = ["and", "cat", "the"]
    want, ids = Counter(), lm.TokenIds(words)
    for t in texts:
        tokens = [0, *[ids[w] for w in (t or "").lower().split()], 0]
        if len(tokens) > 2:
            want.update(a * ids.size + b for a, b in zip(tokens, tokens[1:]))  # noqa: B905
    plain = lm.id_and_text(docs).repartition(5)
    for most in (10, 2_000_000):
        assert {r.pair: r.n for r in lm.pair_counts(plain, words, most).collect()} == dict(want)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    branch = lm.Branch(rng.normal(0, 1, (7, 4)), rng.normal(0, 1, (4, 7)), rng.normal(0, 1, 7))
    rows, counts = np.array([1, 3, 6]), rng.integers(0, 5, (3, 7)).astype(float)
    _, grads = branch.gradients(rows, counts)
    for p, g, k in zip((branch.embedding, branch.out, branch.offset), grads, range(3), strict=True):
        at = tuple(rng.integers(0, n) for n in g.shape)
        place = (rows[at[0]], *at[1:]) if k == 0 else at
        p[place] += 1e-5
        high = branch.gradients(rows, counts)[0]
        p[place] -= 2e-5
        low = branch.gradients(rows, counts)[0]
        p[place] += 1e-5
        assert abs((high - low) / 2e-5 - g[at]) < 1e-6


def test_training_reaches_the_counts():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (12, 12)).astype(np.float32) ** 3
    branch = lm.Branch.start(np.full(12, 1 / 12), 12, rng)
    before = branch.gradients(np.arange(12), counts)[0]
    branch.train(counts, rng, epochs=600)
    p = counts / counts.sum(axis=1, keepdims=True)
    best = -float((counts * np.log(np.maximum(p, 1e-30))).sum() / counts.sum())
    assert branch.gradients(np.arange(12), counts)[0] < best + 0.1 < before


def test_gate_sums_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate([*corpus(30), "", None])), "doc_id long, text string")
    scorer = lm.fit(docs, words=5, epochs=2)
    want = np.zeros((lm.LEVELS, lm.LEVELS, 3))
    net, ids = scorer.network, lm.TokenIds(scorer.words)
    for t in corpus(30):
        tokens = [0, *[ids[w] for w in t.split()], 0]
        for l, m, r in zip(tokens, tokens[1:], tokens[2:]):  # noqa: B905, E741
            parts = np.array([net.left[l, m], net.right[r, m], net.frequency[m]], float) * net.gate[net.level[l], net.level[r]]
            want[net.level[l], net.level[r]] += parts / parts.sum()
    assert np.allclose(lm.shares(lm.id_and_text(docs).repartition(3), scorer.words, net), want, rtol=1e-5)


def test_scores_are_sums_of_normalised_conditionals(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(corpus(200))], "doc_id long, text string, log_prob double")
    scorer = lm.fit(docs, words=10)
    table = scorer.network.table()
    assert np.allclose(table.sum(axis=2), 1, atol=1e-4) and (table >= 0).all()
    rng = random.Random(1)
    test = corpus(40, seed=8)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in test]
    rows = [(i, t) for i, t in enumerate([*test, *mixed, "", None])]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), scorer).collect()}
    for i, t in rows:
        tokens = [0, *[lm.TokenIds(scorer.words)[w] for w in (t or "").split()], 0]
        want = sum(float(np.log(table[a, c, b])) for a, b, c in zip(tokens, tokens[1:], tokens[2:]))  # noqa: B905
        assert got[i].n_tokens == len(tokens) - 2 and abs(got[i].log_prob - want) < 1e-3
    assert got[80].log_prob == 0 and got[81].mean_log_prob is None
    held = sum(got[i].log_prob for i in range(40)) / sum(got[i].n_tokens for i in range(40))
    broken = sum(got[i].log_prob for i in range(40, 80)) / sum(got[i].n_tokens for i in range(40, 80))
    unigram = Counter(w for t in test for w in t.split())
    flat = sum(n * np.log(n / sum(unigram.values())) for n in unigram.values()) / sum(unigram.values())
    assert held > flat + 0.8 and held > broken + 1


def test_word_order_of_held_out_documents_is_learned(spark):
    """Documents that are not trained on score half a nat a symbol better than by the symbols' frequencies, and clearly
    better than with their words shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select("doc_id", "text")
    held = docs.where("crc32(cast(doc_id as string)) % 4 = 2")
    scorer = lm.fit(docs.join(held, "doc_id", "left_anti"))
    texts = [r.text for r in held.orderBy("doc_id").limit(400).collect()]
    rng = random.Random(1)
    ids, found = lm.TokenIds(scorer.words), []
    for some in (texts, [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]):
        symbols, lengths = lm.edged(some, ids)
        at = lm.windows(lengths)
        found.append(scorer.network.log_prob(symbols[at - 1], symbols[at + 1], symbols[at]).mean())
    flat = np.log(scorer.network.frequency[symbols[at]]).mean()
    assert found[0] > flat + 0.5 and found[0] > found[1] + 0.2


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, lm.fit(docs)).count() == 0


def test_words_outside_the_vocabulary_are_predicted(spark):
    texts = [*corpus(200), "the zzgrass sees some zzwater and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scorer = lm.fit(docs, words=4)
    rows = [(0, "the bird sees some grass and"), (1, "the zird sees some zzgrass and"), (2, "the xkqv sees some qqqss and")]
    got = {r.doc_id: r.log_prob for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), scorer).collect()}
    # junk of the same length and last letters falls into the same classes
    ids = lm.TokenIds(scorer.words)
    assert ids["bird"] == ids["zird"] and ids.size == 4 + 1 + lm.BUCKETS
    assert got[0] > got[1] + 5 and got[0] > got[2] + 5
    totals = Counter(w for t in texts for w in t.split())
    assert {r.word: r["count"] for r in scorer.counted.collect()} == dict(totals)


def test_listed_words_score_as_joined_ones(spark):
    docs = spark.createDataFrame(list(enumerate([*corpus(60), "zz yy zz", "", "q" * 5000])), "doc_id long, text string")
    few, many = lm.fit(docs, words=3, listed=0), lm.fit(docs, words=3, listed=4)
    assert not few.listed and len(many.listed) == 4 and few.words == many.words
    rows = spark.createDataFrame([(0, "the bird sees some grass and qq"), (1, "zz zz the bird"), (2, ""), (2, "food food"), (3, "q" * 5000)], "doc_id long, text string")
    a, b = (sorted((r.doc_id, r.n_tokens, round(r.log_prob, 4)) for r in lm.score(rows, s).collect()) for s in (few, many))
    assert a == b
