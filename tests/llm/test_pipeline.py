import public_tokenizers

import corpus_pipeline
from inkstone.llm import packing, pii, quality_model
from tests.llm.test_near_texts import similar_pairs, slow_groups
from tests.llm.test_packing import check_pieces
from tests.llm.test_quality_rules import slow_measures

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], SF)
        steps.append(out.cache())
    for step in steps[1:-1]:
        assert step.columns == docs.columns
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]

    for i, text in texts[0].items():  # rules: no failing measure stays, cleaned lines are lines of the text
        if i in texts[1]:
            assert not slow_measures(text)[5]
            assert set(texts[1][i].split("\n")) <= set(text.split("\n"))
            assert 2 * len("".join(texts[1][i].split())) >= len("".join(text.split()))
    assert 0 < len(texts[1]) < len(texts[0])

    model = quality_model.fit(quality_model.features(docs), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_model.score(quality_model.features(steps[1]), model).where("predicted = 1").collect()}
    assert set(texts[2]) == good and all(texts[2][i] == texts[1][i] for i in good)

    ids = sorted(texts[2])
    groups = slow_groups(len(ids), similar_pairs([texts[2][i] for i in ids]))
    assert set(texts[3]) == {ids[g] for g in groups}

    for i, text in texts[4].items():
        assert not pii.base_spans(text.replace("<", " ")) or "<" in text
        if not pii.base_spans(texts[3][i]):
            assert text == texts[3][i] or "<" in text
        assert "@" not in text or "@" in texts[3][i]
    assert set(texts[4]) == set(texts[3])

    assert packing.load_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    check_pieces(steps[5].collect(), texts[4])


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
