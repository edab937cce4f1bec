import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.llm import byte_contexts as bc

SCHEMA = "doc_id long, text string, lang string"


def kept_for_test(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute_model(rows, least=1):
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if lang is None or kept_for_test(doc_id):
            continue
        data = b"\n" * 4 + (text or "").encode()
        for i in range(4, len(data)):
            for order in range(5):
                counts[lang, order][data[i - order : i + 1]] += 1
    return {k: {g: n for g, n in c.items() if n >= least} for k, c in counts.items()}


def brute_length(counts, lang, text):
    bits = lambda a, b: int(np.rint(-np.log2(a / b) * 65536))
    data, total = b"\n" * 4 + text.encode(), 0
    for i in range(4, len(data)):
        for order in range(4, -1, -1):
            followers = {g: n for g, n in counts.get((lang, order), {}).items() if g[:-1] == data[i - order : i]}
            whole = sum(followers.values()) + len(followers)
            if (seen := followers.get(data[i - order : i + 1])) is not None:
                total += bits(seen, whole)
                break
            if followers:
                total += bits(len(followers), whole)
        else:
            total += 8 * 65536
    return total


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = {"aa": ["abra", "cad", "zéb"], "bb": ["xyl", "abr", "quo"], None: ["???"]}
    return [(k, " ".join(rng.choices(words[lang], k=rng.randrange(1, 6))), lang) for k in range(40) for lang in [rng.choice(list(words))]]


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_code_lengths_equal_brute_force(spark, rows, piece, monkeypatch):
    monkeypatch.setattr(bc, "PIECE", piece)
    model = bc.fit(spark.createDataFrame(rows, SCHEMA).repartition(3))
    counts = brute_model(rows)
    texts = [r[1] for r in rows[:8]] + ["", "q", "abrax ünknown", "zéb zéb"]
    found = model.of_texts(pa.array(texts))
    assert model.langs == ["aa", "bb"]
    assert found.tolist() == [[brute_length(counts, lang, t) for lang in model.langs] for t in texts]


def test_bounded_model_equals_brute_force(spark, rows):
    model = bc.fit(spark.createDataFrame(rows, SCHEMA), cells=240)
    held = sum(c.size for c in model.costs)
    assert 0 < held <= 240
    least = next(n for n in range(2, 500) if sum(len(c) for c in brute_model(rows, n).values()) <= 120)
    counts = brute_model(rows, least)
    assert model.of_texts(pa.array(["abra quo", "zébxyl"])).tolist() == [[brute_length(counts, lang, t) for lang in ("aa", "bb")] for t in ("abra quo", "zébxyl")]


def test_slices_of_columns():
    column = pa.array(["x", "ab", "", "cde", None or "f"])[1:4]
    data, starts = bc.padded(column)
    assert bytes(data) == b"\n\n\n\nab" + b"\n\n\n\n" + b"\n\n\n\ncde"
    assert starts.tolist() == [4, 10, 14]


def test_edge_cases(spark, rows):
    more = [(None, "abra cad", "aa"), (900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "xyl quo " * 300_000, None), (904, "abra", None), (904, "abra", None)]
    table = spark.createDataFrame(rows + more, SCHEMA).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y")).withColumn("n", F.lit(1))
    model = bc.fit(table)
    out = bc.predict(table, model).collect()
    assert len(out) == len(rows) + len(more)
    by = {r.doc_id: r for r in out}
    assert [(by[k].lang_pred, by[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "aa" and by[903].lang_pred == "bb" and by[904].lang_pred == "aa"
    assert all(r.held_out == kept_for_test(r.doc_id) and 0 <= r.score <= 1 for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    assert bc.predict(empty, model).collect() == []
    assert {(r.lang_pred, r.score) for r in bc.predict(table, bc.fit(empty)).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError, match="languages"):
        bc.fit(table, languages=1)


def test_ties_go_to_the_smallest_name(spark):
    ids = [k for k in range(20) if not kept_for_test(k)][:2]
    table = spark.createDataFrame([(ids[0], "same", "b"), (ids[1], "same", "a")], SCHEMA)
    assert {(r.lang_pred, r.score) for r in bc.predict(table, bc.fit(table)).collect()} == {("a", 0.5)}


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet(str(Path("/root/testdata/sf0.01/documents.parquet")))
    found = bc.predict(docs, bc.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 200
    assert (found.lang == found.lang_pred).mean() > 0.98


def test_partial_counts_are_told_early(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    key = lambda most: sorted(bc.count_grams(table.where("lang is not null"), most=most).collect())
    assert key(10) == key(2_000_000)
