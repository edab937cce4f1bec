import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkstone.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "Hello, World's 123 naïve İstanbul ΣΑΣ ΑΣ.", "<|endoftext|>a<|startoftext|><|ENDOFTEXT|> <|EndOfText|>", "a\x1cb \x1d\x1e c\x1f",
    "é 가 x y z\u0085w​", "ab" * 4000, "!!!" * 3000 + "'s'T'RE", "x\x00y\x00", "½ Ⅷ ² 漢字かな العربية עברית ไทย 😀👩‍👩‍👧", "don't we'll I'd they're 'tis ''s",
    "ſt K Å ﬁ ß ẞ ǅ", "don'T", "it'S <|endoftext|", "  \x0b\x0c\r\n\t",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    rng = random.Random(9)
    letters = "abcdefghijklmnop   \n\t'’.,!?-ABCÉéüßñΣσς0123́ \x1c😀漢"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_ids_and_text_equal_the_library(library):
    vocabulary = bpe.load_vocabulary(PATH)
    texts = ODD + random_texts(3000)
    for lexicon in ({}, {w.encode(): vocabulary.encode_word(w) for w in ("hello,", "a", "ab", "we'll", "naïve", "b")}):
        encoder = bpe.Encoder(vocabulary, bpe.Transducer.open(bpe.Transducer.compile(lexicon)), keep=500)
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            ids = encoder.encode(part)
            want = [library.encode(t, add_special_tokens=False).ids for t in part]
            assert ids.to_pylist() == want
            assert vocabulary.decode(ids).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_long_merge_equals_short():
    vocabulary = bpe.load_vocabulary(PATH)
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"thereandinging") for _ in range(rng.randint(1, 24)))
        first = [vocabulary.inner[b] for b in piece[:-1]] + [vocabulary.final[piece[-1]]]
        assert vocabulary._merge_long(first) == vocabulary.merge(piece)


def test_side_by_side_merges_equal_single_ones():
    vocabulary = bpe.load_vocabulary(PATH)
    rng = random.Random(8)
    pieces = [bytes(rng.choice(b"thereandinging\xc3\xa9.") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + [b"\0", b"\0\0a"]
    got = vocabulary.merge_many(pieces, block=700)
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [vocabulary.merge(p) for p in pieces]
    assert vocabulary.merge_many([]) == []


def test_transducer_is_minimal_and_exact():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))).encode() for _ in range(600)}
    lexicon = {w: [len(w), w[0]] for w in words}
    t = bpe.Transducer.open(bpe.Transducer.compile(lexicon))
    probes = sorted(words) + [b"", b"abcabcabcabc", b"zzz", b"ab\x00"] + [w + b"d" for w in words]
    numbers = t.find(probes)
    for w, n in zip(probes, numbers.tolist(), strict=True):
        assert (n >= 0) == (w in words)
        if n >= 0:
            assert t.output(n).tolist() == lexicon[w]
    assert numbers[: len(words)].tolist() == list(range(len(words)))
    right = set()  # states of the minimal automaton: distinct sets of continuations
    for w in words | {b""}:
        for k in range(len(w) + 1):
            right.add(frozenset(x[k:] for x in words if x.startswith(w[:k])))
    assert len(t.finals) == len(right)


def test_operator_on_awkward_tables(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, None), (3, ODD[3], "x"), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, decoded=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            text = "" if r.doc_id == 99 else ODD[r.doc_id]
            assert r.ids == library.encode(text, add_special_tokens=False).ids
            assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {r.doc_id: r.decoded for r in got}
    assert bpe.token_digests(bpe.encode(docs.limit(0), decoded=True)).count() == 0


def test_frequent_words_split_the_last_bin(spark):
    copied = " ".join(f"copy{i:03d}" for i in range(200))
    docs = spark.createDataFrame([(i, copied) for i in range(40)] + [(90 + i, "often " * 50 + "copy007 rare rare") for i in range(2)], "doc_id long, text string")
    assert sorted(bpe.frequent_words(docs, 95)) == sorted(["often", "copy007", *(f"copy{i:03d}" for i in range(94) if i != 7)])
    assert len(bpe.frequent_words(docs, 1)) == 1 and bpe.frequent_words(docs, 0) == []
    assert len(bpe.frequent_words(docs, 202)) == 202 == len(bpe.frequent_words(docs, 999))
