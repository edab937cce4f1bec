import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm import packing


def test_cuts_cost_as_little_as_exhaustive_search():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.randint(4, 20)
        spots = [0]
        for _ in range(rng.randint(1, 14)):
            spots.append(spots[-1] + rng.randint(1, window))
        pens = [float(rng.choice([0, 1, 5])) for _ in spots]
        cuts = packing.Cuts(window)
        cuts.add(spots[1:], pens[1:])
        slow = [0.0]
        for k in range(1, len(spots)):
            slow.append(min(slow[i] + pens[k] + window - spots[k] + spots[i] for i in range(k) if spots[k] - spots[i] <= window))
        assert cuts.best == slow
        given = cuts.finish()
        cost = dict(zip(spots, pens, strict=True))
        assert given[-1] == spots[-1] and slow[-1] == sum(cost[b] + window - b + a for a, b in zip([0, *given], given))  # noqa: B905


def stream(packer, texts):
    rows = [row for n, ids in enumerate(texts) for row in packer.add(n, ids)]
    return rows + list(packer.finish())


def test_blocks_change_nothing():
    rng = np.random.default_rng(4)
    ends = np.zeros(50, bool)
    ends[[1, 2]] = True
    for window in (5, 32, 64):
        texts = [np.append(rng.integers(1, 50, rng.choice([0, 3, 70, 900])), 0).astype(np.uint32) for _ in range(40)]
        texts.insert(7, np.append(np.full(3000, 9), 0).astype(np.uint32))  # no sentence ends
        whole = stream(packing.Packer(ends, window=window, block=1 << 18), texts)
        for block in (1, 7, 300, 1000, 5000):
            assert stream(packing.Packer(ends, window=window, block=block), texts) == whole
        packer = packing.Packer(ends, window=window, block=300)
        most = 0
        for n, ids in enumerate(texts):
            list(packer.add(n, ids))
            most = max(most, packer.end - packer.low)
        assert most < 4000  # of 15,000: a stretch without ends of sentences is held, a block's edge is not


def test_whole_stream_costs_as_little_as_exhaustive_search():
    rng = np.random.default_rng(6)
    ends = np.zeros(50, bool)
    ends[[1, 2]] = True
    for window in (6, 40):
        texts = [np.append(rng.integers(1, 50, rng.choice([0, 3, 70, 300])), 0).astype(np.uint32) for _ in range(20)]
        rows = stream(packing.Packer(ends, window=window, block=200), texts)
        sizes: dict = defaultdict(int)
        for r in rows:
            sizes[r[5]] += r[2]
        cuts = np.cumsum([sizes[k] for k in sorted(sizes)]).tolist()
        joined = np.concatenate(texts)
        doc_ends = set(np.cumsum([len(t) for t in texts]).tolist())
        marks = sorted(doc_ends | set((np.flatnonzero(ends[joined]) + 1).tolist()))
        cost = {0: 0.0} | {m: 0.0 if m in doc_ends else 8.0 for m in marks}
        for a, b in zip([0, *marks], marks):  # noqa: B905
            if b - a > min(48, window):
                cost |= {x: 24.0 for x in range(a + min(16, window), b, min(16, window))}
        places, best = sorted(cost), {0: 0.0}
        for k in places[1:]:
            best[k] = min(best[i] + cost[k] + window - k + i for i in places if i < k and k - i <= window)
        assert sum(cost[c] + window - c + a for a, c in zip([0, *cuts], cuts)) == best[places[-1]]  # noqa: B905


def test_ids_equal_the_reference_library():
    encoder, _ = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a  b", "a   b\n\n c \n", "It's <|endoftext|>fine<|endoftext|>", "naïve Ünïcode 😀 １２", " x y", "a" * 5000, " " * 3000 + "x", "<|endof text|>", "\x00\x1c"]
    for text in texts:
        assert packing.encode(encoder, text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], text[:20]


def check_pieces(rows, texts, window=1024):
    encoder, _ = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids = packing.encode(encoder, text or "")
        own = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes()
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and r.length * 4 == len(r.ids)
            at += r.length
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(5)
    words = "one two three four. five! Six? seven eight\n".split(" ")
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200, 3000]))) for i in range(60)}
    texts[60], texts[61], texts[62] = None, "x" * 20_000, "word " * 60_000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    check_pieces(packing.pack(docs).collect(), texts)
    check_pieces(packing.pack(docs, window=32, block=500).collect(), texts, 32)
    rows = packing.pack(docs.repartition(1)).collect()
    used = sum(r.length for r in rows)
    assert used / (1024 * len({r.sequence_id for r in rows})) > 0.97


def test_small_cases(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    got = packing.piece_digests(packing.pack(spark.createDataFrame([(1, ""), (1, ""), (None, None)], schema))).collect()
    assert [r.length for r in got] == [1, 1, 1]
    assert {r.ids_crc32 for r in got} == {zlib.crc32(np.zeros(1, np.uint32).tobytes())}
