import random
import time
from collections import defaultdict

import numpy as np
import pytest

from inkstone.llm import near_texts
from inkstone.runtime import Scratch


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def similar_pairs(texts, least=0.8):
    """{(i, j): similarity} of all pairs of different texts at ``least`` or more, by brute force over shared shingles."""
    sets = [shingle_set(t) for t in texts]
    holders, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                shared[j, i] += 1
    return {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def slow_groups(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def planted(rng, families, copies, edits):
    texts = []
    for _ in range(families):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 40, 150, 600]))]
        texts.append(" ".join(words))
        for _ in range(copies):
            new = list(words)
            for _ in range(rng.randint(0, max(1, int(len(new) * edits)))):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(new))
    rng.shuffle(texts)
    return texts


def groups_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_texts.text_groups(docs, **options).collect()
    return {r["first"].doc_id: r.root for r in rows}


@pytest.mark.parametrize(("families", "copies", "edits", "block"), [(60, 5, 0.03, 512), (2, 80, 0.02, 7)])
def test_groups_equal_brute_force(spark, families, copies, edits, block):
    texts = sorted(set(planted(random.Random(families), families, copies, edits)))
    pairs = similar_pairs(texts)
    want = slow_groups(len(texts), pairs)
    got = groups_of(spark, texts, block=block)
    assert set(got) == set(range(len(texts)))
    found = {(i, j) for i, j in pairs if got[i] == got[j]}
    for lo, hi, share in ((0.8, 0.85, 0.93), (0.85, 0.9, 0.98), (0.9, 1.01, 1.0)):
        of = [p for p, s in pairs.items() if lo <= s < hi]
        assert len(found.intersection(of)) >= share * len(of), (lo, len(of))
    by_root = defaultdict(set)
    for i, r in got.items():
        by_root[r].add(want[i])
    assert all(len(v) == 1 for v in by_root.values())  # nothing is joined that brute force does not join


def test_given_documents_keep_one_of_each_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({r.text or "" for r in docs.select("text").collect()})
    pairs = similar_pairs(texts)
    want, got = slow_groups(len(texts), pairs), groups_of(spark, texts)
    missing = {" ".join(texts[i].encode().lower().decode().split()) for i in range(len(texts)) if i not in got}
    assert missing <= {" ".join(texts[i].lower().split()) for i in got}  # texts of equal words are one class
    joined = [(i, j) for i, j in pairs if i in got and j in got]
    assert sum(got[i] == got[j] for i, j in joined) >= 0.97 * len(joined)
    assert len({(got[i], want[i]) for i in got}) == len({r for r in got.values()})


def test_awkward_tables(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (5, "alpha beta gamma delta epsilon zeta", 1), (4, "Alpha beta  gamma delta\nepsilon zeta", 2), (5, "alpha beta gamma delta epsilon zeta", 3), (5, "another text", 4),
        (None, "another text", 5), (None, "lonely words", 6), (None, "lonely words", 7), (7, None, 8), (8, "", 9), (9, " \n", 10), (10, long, 11), (11, long + " tail", 12), (12, "another", 13),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    kept = near_texts.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:12]) for r in kept.collect()), key=str)
    assert got == sorted([(4, "Alpha beta  "), (5, "another text"), (None, "lonely words"), (7, ""), (10, "w0 w1 w2 w3 "), (12, "another")], key=str)
    assert near_texts.keep_one(docs.limit(0)).count() == 0


def test_bytes_tell_similar_sets_from_others():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    sets = [every[i : i + 200] for i in range(0, 20_000, 200)]
    near = [np.concatenate((s[:180], every[20_000 + i : 20_020 + i])) for i, s in enumerate(sets)]
    signer = near_texts.Signer()
    a, b = signer.sign(sets), signer.sign(near)
    assert ((a == b).sum(axis=1) >= 16).mean() >= 0.98 and (a == np.roll(a, 1, axis=0)).sum(axis=1).max() < 8
    single = signer.sign([every[i : i + 1] for i in range(500)])  # one shingle is enough to be told apart
    assert (single[:-1] == single[1:]).sum(axis=1).max() < 30
    assert (signer.sign([sets[0]]) == a[:1]).all()


def exact_groups(texts, lists=48, together=3, minimum=16, similarity=0.8):
    """Components of all pairs that share a list, enough bytes and enough shingles, one by one; and how many pairs there are."""
    sets = [near_texts.shingles(t)[1] for t in texts]
    signatures = near_texts.Signer().sign(sets)
    keys = near_texts.list_keys(signatures, near_texts.places_of(lists, together))
    members = defaultdict(list)
    for i, row in enumerate(keys):
        for k in row.tolist():
            members[k].append(i)
    pairs = {(i, j) for m in members.values() for n, i in enumerate(m) for j in m[n + 1 :]}
    fits = lambda i, j: min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j]))
    retained = [(i, j) for i, j in pairs if (signatures[i] == signatures[j]).sum() >= minimum and fits(i, j)]
    links = [p for p in retained if near_texts.similar(sets[p[0]], sets[p[1]], similarity)]
    return slow_groups(len(texts), links), len(retained), len(links)  # what shares no list may be joined too


@pytest.mark.parametrize(("edits", "block"), [(9, 1024), (9, 16), (14, 64)])
def test_every_retained_pair_counts(spark, edits, block):
    """A dense group around one text whose members are about as similar as the limit, some linked and most not."""
    rng = random.Random(edits)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(180):
        new = list(base)
        for _ in range(rng.randrange(edits - 5, edits)):
            new[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(new))
    want, retained, links = exact_groups(texts)
    assert retained > 2000 and links < retained
    got = groups_of(spark, texts, block=block)
    every = slow_groups(len(texts), similar_pairs(texts))
    assert len({(want[i], got[i]) for i in got}) == len(set(want))  # what a list shows is joined
    assert len({(got[i], every[i]) for i in got}) == len(set(got.values()))  # and nothing that is not similar


def test_written_tables_are_removed(spark):
    from inkstone.runtime import ensure_checkpoint_dir

    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().toString() for s in system.listStatus(folder) if "near-texts" in s.getPath().getName()}
    before = names()
    groups_of(spark, ["a b c d e f", "a b c d e f g"])
    (new,) = names() - before
    left = system.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new))
    assert len(left) == 1  # what the result reads


def test_roots_of_trees(spark):
    rng = random.Random(5)
    above = {k: k - 1 for k in range(-40, 60)} | {k: rng.randrange(100, k) for k in range(101, 300)} | {k: 300 for k in range(301, 600)}

    def top(k):
        while k in above:
            k = above[k]
        return k

    links = spark.createDataFrame([(a, b) for b, a in above.items()], "a long, b long").repartition(3)
    scratch = Scratch(spark, "trees")
    assert {r.node: r.root for r in near_texts.tree_roots(links, scratch).collect()} == {k: top(k) for k in above}
    assert near_texts.tree_roots(links.limit(0), scratch).count() == 0


def test_shuffle_files_go_with_their_queries(spark):
    """Those of all rounds stayed until the driver's garbage was collected."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def ids():
        found = disk.getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}

    docs = spark.createDataFrame([(k, " ".join(f"w{(k // 2 * 31 + j) % 97}" for j in range(40 + k % 2))) for k in range(60)], "doc_id long, text string")
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", ids()
    near_texts.text_groups(docs)
    deadline = time.time() + 20
    while ids() - before and time.time() < deadline:  # removal does not block
        time.sleep(0.2)
    assert not ids() - before
    assert spark.conf.get(key, None) is None
