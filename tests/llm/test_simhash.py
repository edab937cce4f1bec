import random
import re

import numpy as np
import pytest
import xxhash

from inkstone.llm import simhash


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance):
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {f: top(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(rng, centres, members, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            x = c
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.add(signed(x))
    return sorted(out)


TEXTS = [None, "", " \t\n", "One two", "ONE  two", "a b c d", "a b c d e", "É é É é ß", "a\x1cb c d e f", "word " * 500, " ".join(f"w{i}" for i in range(40_000))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS[:-1]] + [" ".join(rng.choice("a b C dd éé F\n".split(" ")) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("limit", [2, 5, 64])
@pytest.mark.parametrize("distance", [4, 2])
def test_groups_equal_brute_force(spark, limit, distance):
    rng = random.Random(limit)
    fps = clusters(rng, 12, 12, 4) + clusters(rng, 2, 40, 3) + [0, -1, 1, signed(1 << 63)]
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {f: f for f in fps}
    got.update({r.node: r.root for r in simhash.components(simhash.links(frame, distance, limit)).collect()})
    assert got == slow_components(fps, distance)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_operator_on_awkward_tables(spark):
    rows = [(10 - i, t, i) for i, t in enumerate(TEXTS)] + [(10, None, 1), (None, "lonely text of five words", 2), (77, TEXTS[-1] + " tail", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_text().alias("hex"), "component_id").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        assert by[10 - i].hex == f"{slow_fingerprint(t or ''):016x}"
    assert {by[i].component_id for i in (8, 9, 10)} == {8} and by[6].component_id == by[7].component_id == 6
    assert by[77].component_id == by[0].component_id == 0 and by[None].component_id is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 8 in ids and 9 not in ids and 77 not in ids
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_goes_by_text_not_by_id_alone(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "one two three four five six", "le chat dort dans la maison")
    rows = [(7, one), (7, two), (7, two), (8, one), (None, three), (None, three), (None, two)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, one), (7, two), (None, three)], key=str)


def test_the_tally_refuses_pairs_of_a_list():
    one = 0x0102030405060708
    three = 0x01020304FFFFFFFF ^ 0x1100_0000_0000_0000  # shares three bytes with it
    four = one ^ 0x0101_0101_0000_0000
    members = np.array([one, three, four], np.int64)
    shared = (members.view(np.uint8).reshape(-1, 8) == members.view(np.uint8).reshape(-1, 8)[0]).sum(axis=1)
    assert shared.tolist() == [8, 3, 4]
    masks = simhash.position_masks(3)
    meets = lambda a, b: any(int(a) & m == int(b) & m for m in masks)
    assert meets(one, four) and meets(one, three)
    assert simhash.retained_pairs(members, 0, np.array([1, 2]), 4).tolist() == [2]
    assert simhash.list_edges(members, 4) == [(one, four)]


def test_a_list_of_every_size_gives_the_same_groups(spark):
    rng = random.Random(8)
    core = rng.getrandbits(63)
    fps = sorted({core ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(6))) for _ in range(300)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = [sorted((r.node, r.root) for r in simhash.components(simhash.links(frame, 4, limit, most)).collect()) for limit, most in ((8, 1000), (1024, 1000), (1024, 10))]
    assert found[0] == found[1] == found[2]
