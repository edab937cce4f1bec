"""SimHash near-duplicates of texts: byte positions find candidates, the shingles themselves decide.

Texts link when the Jaccard similarity of their sets of five-word shingles is ``similarity`` (0.8) or more; linked texts
form groups, and one row of each group stays. Eight packed sign bits of a 64-bit SimHash survive that similarity too
seldom (15 % of the bits differ), so the fingerprint here has 64 positional bytes of another make: each byte names the
strongest of 128 SimHash votes and its sign. Unlike texts share a byte by chance (1/256); texts at 0.8 share about 26 of
the 64 bytes, at 0.9 about 36.

    index     each of ``lists`` inverted lists is keyed by ``together`` byte positions
    tally     texts that meet in a list share some number of their 64 bytes
    filter    pairs that share at least ``minimum`` bytes are retained (99 of 100 pairs at 0.8 do), provided the sizes of
              their sets allow the similarity
    verify    the Jaccard similarity of the retained pairs' whole sets is computed

First every text meets the first text (the one with the smallest hash) of each of its lists, and is verified against the one
with which it shares most bytes. Those links give components. Then every retained pair between two components is looked
after: in lists that still hold several components, each text outside the first text's component is tallied against the
others, and asks every cluster of which it retains a member of another component. Clusters are what the best pairs join
before they are verified, so they hold components whole, and a group of texts that resemble each other is one of a few. A
text that asks a cluster is verified against the members it retains there, in falling order of shared bytes, until one of
each component links; one is enough, since the members are linked already. So no retained pair is left out, there are no
rounds, and pairs are never rows: tables hold a row for each text and asked cluster, and tasks hold blocks of ``block``
askers and ``block`` members with their sets.

Between texts of one component nothing is verified, so a large group of near copies costs its texts, not its pairs. A
group of n texts that all retain each other and do not link needs n / ``block`` copies of each, and each such pair has to
be refused by its sets: quadratic work that spreads over tasks of bounded size.

A pair at similarity 0.8 meets in at least one list with a probability of about 0.96, at 0.85 with 0.995, at 0.9 with
0.9999 (24-bit keys, 48 lists; the tests measure this). A list holds N / 2**(8 * together) unlike texts by chance: three
bytes suit some tens of millions of distinct texts; for more, take four bytes and 160 lists.

Equal texts (equal sequences of lower-cased words) are one class from the start. Joins that meet a frequent text or list
are salted. Nothing about texts goes to the driver but counts. Hashes of 64 bits stand for texts.

Defined results: a null text is an empty one; texts without words are copies of each other. Rows that repeat, and unlike
texts under one id, are told apart by text: of each group the row with the smallest id (null is the greatest), then text
hash, stays, once. Extra columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import id_and_text, slices
from inkstone.llm.simhash import components, keep_rows, with_roots
from inkstone.runtime import Scratch, shuffle_files_removed

DIM = 1024  # coordinates of the vote sketch
TIMES = 4  # coordinates of a shingle
VOTES = 128  # votes behind a byte
BYTES = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd constant of a multiplicative hash


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str, width: int = 5) -> tuple[int, np.ndarray]:
    """(hash of the text's words, sorted distinct hashes of its shingles); fewer words than ``width``: all of them."""
    words = text.encode().lower().split()
    key = xxhash.xxh64_intdigest(b" ".join(words), 7)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - width + 1, 1)
    found = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        found = _scramble(found + each[k : k + n])
    return key, np.unique(found)


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


class Signer:
    """Fingerprints: shingles vote on coordinates, two rounds of random signs and Hadamard rotations mix the votes."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.side = _hadamard(32)
        self.signs = rng.choice(np.array([-1, 1], np.float32), (1 + BYTES * VOTES // DIM, DIM))

    def _rotate(self, votes: np.ndarray) -> np.ndarray:
        return (self.side @ votes.reshape(-1, 32, 32) @ self.side).reshape(votes.shape)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of ``BYTES`` bytes for each set."""
        every = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)) * DIM, [len(s) for s in sets])
        votes = np.zeros(len(sets) * DIM)
        for k in range(TIMES):
            h = _scramble(every + np.uint64(k + 1))
            votes += np.bincount(row + (h % np.uint64(DIM)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)), len(votes))
        mixed = self._rotate(votes.reshape(len(sets), DIM).astype(np.float32) * self.signs[0])
        found = []
        for signs in self.signs[1:]:
            turned = self._rotate(mixed * signs).reshape(len(sets), -1, VOTES)
            top = np.abs(turned).argmax(axis=2)
            found.append(2 * top + (np.take_along_axis(turned, top[..., None], 2)[..., 0] > 0))
        return np.concatenate(found, axis=1).astype(np.uint8)


def places_of(lists: int, together: int, seed: int = 12) -> np.ndarray:
    """The byte positions of each list; every position serves about equally often."""
    rng, fit = np.random.default_rng(seed), BYTES // together
    rows = [rng.permutation(BYTES)[: fit * together].reshape(fit, together) for _ in range(-(-lists // fit))]
    return np.concatenate(rows)[:lists]


def list_keys(signatures: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The key of each list of each signature."""
    keys = np.repeat(np.arange(len(places), dtype=np.int64)[None, :], len(signatures), axis=0)
    for k in range(places.shape[1]):
        keys = keys << 8 | signatures[:, places[:, k]]
    return keys


def classes_of(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, first, size, signature`` of each distinct text; ``first`` is the row that stands for it."""

    def run(batches):
        signer = Signer()
        for batch in slices(batches):
            found = [shingles(t, width) for t in batch.column(1).to_pylist()]
            signatures = signer.sign([s for _, s in found])
            arrays = [
                batch.column(0), batch.column(2), pa.array(np.array([k for k, _ in found], np.uint64).view(np.int64)),
                pa.array([len(s) for _, s in found], pa.int32()), pa.array([s.tobytes() for s in signatures], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "key", "size", "signature"])

    plain = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = plain.mapInArrow(run, "doc_id long, text_hash long, key long, size int, signature binary")
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash", "size", "signature")
    return rows.groupBy("key").agg(F.min(row).alias("r")).select("key", F.struct("r.without", "r.doc_id", "r.text_hash").alias("first"), "r.size", "r.signature")


def crowded_lists(classes: DataFrame, lists: int, together: int, scratch: Scratch) -> DataFrame:
    """``list, key, centre, n``: members of lists with two texts or more, and the first text of their list."""
    places = places_of(lists, together)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BYTES)
                keys = np.repeat(batch.column(0).to_numpy(), len(places))
                yield pa.RecordBatch.from_arrays([pa.array(list_keys(signatures, places).ravel()), pa.array(keys)], ["list", "key"])

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select("key", "signature").repartition(parts, F.xxhash64("key"))  # few partitions hold them, each gives many rows
    index = dealt.mapInArrow(run, "list long, key long")
    sizes = scratch.write(index.groupBy("list").agg(F.count("*").alias("n"), F.min("key").alias("centre")).where("n >= 2"))
    return scratch.write(_join_frequent(index, sizes.select("list", "centre"), sizes.select("list", F.col("n").alias("degree")), "list", "key"))


def best_centres(members: DataFrame, classes: DataFrame, minimum: int, similarity: float, scratch: Scratch) -> DataFrame:
    """``a, b``: for each text b the first text of a list of its that it retains and shares most bytes with."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BYTES) for k in (2, 3))
                tally = (left == right).sum(axis=1)
                keep = pa.array(tally >= minimum)
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column(0), batch.column(1), pa.array(tally))], ["a", "b", "tally"])

    stars = scratch.write(members.where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct())
    of = lambda name: classes.select(F.col("key").alias(name), F.col("size").alias(f"{name}_size"), F.col("signature").alias(f"{name}_bytes"))
    degree = stars.groupBy("a").agg(F.count("*").alias("degree"))
    both = _join_frequent(stars.join(of("b"), "b"), of("a"), degree, "a", "b")
    fits = F.least("a_size", "b_size") >= F.lit(similarity) * F.greatest("a_size", "b_size")
    told = both.where(fits).select("a", "b", "a_bytes", "b_bytes").mapInArrow(run, "a long, b long, tally long")
    return told.groupBy("b").agg(F.max(F.struct("tally", "a")).alias("best")).select("best.a", "b")


def _join_frequent(rows: DataFrame, side: DataFrame, degree: DataFrame, on: str, other: str, most: int = 1000) -> DataFrame:
    """``rows`` join ``side`` on a key that some rows share very often: rows of such a key are dealt over several salts, as
    many as ``degree`` asks for. Keys of up to ``most`` rows have none, so the table of salts is far smaller than ``rows``."""
    salts = degree.where(F.col("degree") > most).select(on, F.ceil(F.col("degree") / most).cast("int").alias("salts"))
    dealt = rows.join(salts, on, "left").withColumn("salt", F.pmod(F.xxhash64(other, F.lit(2)), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = side.join(salts, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [on, "salt"]).drop("salt")


def shingle_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``key, shingles`` of the texts in ``keys``."""

    def run(batches):
        for batch in slices(batches):
            found = [shingles(t, width) for t in batch.column(0).to_pylist()]
            sets = pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in found], np.uint64).view(np.int64)), sets], ["key", "shingles"])

    wanted = classes.join(keys, "key", "left_semi").select(F.col("first.doc_id").alias("__first"), F.col("first.text_hash").alias("__first_hash"))
    plain = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("text_hash") == F.col("__first_hash"))
    return plain.join(wanted, same, "left_semi").select("text").mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"])


def similar(left: np.ndarray, right: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are as similar as ``similarity``."""
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return shared >= similarity * (len(left) + len(right) - shared)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float, width: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``a, b`` of the pairs whose sets of shingles are as similar as ``similarity``."""

    def run(batches):
        for batch in slices(batches):
            sets = zip(batch.column(2), batch.column(3), strict=True)
            keep = [similar(a.values.to_numpy(), b.values.to_numpy(), similarity) for a, b in sets]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = scratch.write(shingle_sets(docs, classes, keys, width, id_col, text_col))
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("right")), "b")
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    both = _join_frequent(both, sets.select(F.col("key").alias("a"), F.col("shingles").alias("left")), degree, "a", "b")
    return scratch.write(both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"))


def groups_of(batches, width: int):
    """Whole groups of sorted batches: rows that agree in their first ``width`` columns, which are numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        group = np.stack([joined.column(k).to_numpy() for k in range(width)])
        cuts = np.concatenate(([0], np.flatnonzero(np.any(np.diff(group, axis=1) != 0, axis=0)) + 1))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield joined.slice(low, high - low)
        held = [joined.slice(cuts[-1])]  # the last group may go on in the next batch
    yield from held


def _blocked(askers: DataFrame, members: DataFrame, sizes: DataFrame, group: str, block: int, carried: list[str]) -> DataFrame:
    """Askers (``group, key``) and members of groups dealt over blocks of both, in order; each asker meets each member of its
    group in one block. ``sizes`` has ``group, asking, held``: how many there are."""
    degree = sizes.select(group, (F.col("asking") + F.col("held")).alias("degree"))
    sizes = sizes.select(group, F.ceil(F.col("asking") / block).cast("int").alias("chunks"), F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    sized = lambda rows: _join_frequent(rows, sizes, degree, group, "key")
    own = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized(askers).select(group, own("chunks", 3).alias("chunk"), every("blocks").alias("block"), F.lit(1).alias("side"), *carried)
    right = sized(members).select(group, every("chunks").alias("chunk"), own("blocks", 4).alias("block"), F.lit(0).alias("side"), *carried)
    parts = int(askers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(parts, group, "block", "chunk").sortWithinPartitions(group, "block", "chunk")


def asked_clusters(members: DataFrame, classes: DataFrame, rooted: DataFrame, minimum: int, similarity: float, scratch: Scratch, block: int = 1024) -> DataFrame:
    """``key, cluster``: texts outside the component of their list's first text, and the clusters of which they retain a
    member of another component in one of their lists; ``rooted`` has ``key, root, cluster``."""
    centres = rooted.select(F.col("key").alias("centre"), F.col("root").alias("centre_root"))
    told = members.join(rooted, "key").join(centres, "centre")
    told = scratch.write(told.select("list", "key", "root", "cluster", (F.col("root") != F.col("centre_root")).alias("asks")))
    sizes = scratch.write(told.groupBy("list").agg(F.sum(F.col("asks").cast("int")).alias("asking"), F.count("*").alias("held")).where("asking > 0"))
    rows = told.join(classes.select("key", "size", "signature"), "key")
    dealt = _blocked(rows.where("asks"), rows, sizes, "list", block, ["key", "root", "cluster", "size", "signature"])

    def run(batches):
        for group in groups_of(batches, 3):
            side, key, root, cluster, size = (group.column(k).to_numpy() for k in range(3, 8))
            signatures = np.frombuffer(b"".join(group.column(8).to_pylist()), np.uint8).reshape(-1, BYTES)
            found = []
            for i in np.flatnonzero(side):
                apart = np.flatnonzero((side == 0) & (root != root[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i])))
                near = apart[(signatures[apart] == signatures[i]).sum(axis=1) >= minimum]
                found += [(key[i], c) for c in np.unique(cluster[near])]
            if found:
                keys, clusters = map(np.array, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(clusters)], ["key", "cluster"])

    return dealt.mapInArrow(run, "key long, cluster long").distinct()


def across_components(asked: DataFrame, docs: DataFrame, classes: DataFrame, rooted: DataFrame, minimum: int, similarity: float, width: int, id_col: str, text_col: str, scratch: Scratch, block: int = 1024) -> DataFrame:
    """``a, b``: for each text (a) and cluster it asks, a member (b) of each other component that it links with."""
    asked = scratch.write(asked)
    held = rooted.join(asked.select("cluster").distinct(), "cluster", "left_semi").select("key", "cluster")
    keys = asked.select("key").union(held.select("key")).distinct()
    sets = shingle_sets(docs, classes, keys, width, id_col, text_col)
    sets = scratch.write(sets.join(classes.select("key", "size", "signature"), "key").join(rooted.select("key", "root"), "key"))
    sizes = scratch.write(asked.groupBy("cluster").agg(F.count("*").alias("asking")).join(held.groupBy("cluster").agg(F.count("*").alias("held")), "cluster"))
    dealt = _blocked(asked.join(sets, "key"), held.join(sets, "key"), sizes, "cluster", block, ["key", "root", "size", "signature", "shingles"])

    def run(batches):
        for group in groups_of(batches, 3):
            side, key, root, size = (group.column(k).to_numpy() for k in range(3, 7))
            signatures = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint8).reshape(-1, BYTES)
            sets, found, inside = group.column(8), [], np.flatnonzero(side == 0)
            for i in np.flatnonzero(side):
                tally = (signatures[inside] == signatures[i]).sum(axis=1)
                fits = (tally >= minimum) & (root[inside] != root[i]) & (np.minimum(size[inside], size[i]) >= similarity * np.maximum(size[inside], size[i]))
                own, near, linked = sets[int(i)].values.to_numpy(), inside[fits], set()
                for j in near[np.argsort(-tally[fits], kind="stable")]:
                    if root[j] not in linked and similar(own, sets[int(j)].values.to_numpy(), similarity):
                        found.append((key[i], key[j]))
                        linked.add(root[j])
            if found:
                a, b = map(np.array, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return scratch.write(dealt.mapInArrow(run, "a long, b long"))


def tree_roots(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``node, root`` of a forest: each ``b`` has one link to a smaller ``a``; ``root`` is the smallest node of its tree.

    Each round every node takes what its root hangs on as its root, so depths halve; a frequent root is a skewed join.
    """
    now = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(rounds):
        above = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = now.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        moved = scratch.write(moved)
        now = moved.select("node", "root")
        if not moved.where("moved").count():
            return now
    raise RuntimeError(f"trees did not settle in {rounds} rounds")


def text_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, lists: int = 48, together: int = 3, minimum: int = 16, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, first, root`` of each distinct text: texts of one group have the same ``root``."""
    with shuffle_files_removed(docs.sparkSession):
        return _text_groups(docs, similarity, width, lists, together, minimum, block, id_col, text_col)


def _text_groups(docs: DataFrame, similarity: float, width: int, lists: int, together: int, minimum: int, block: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near-texts")
    classes = scratch.write(classes_of(docs, width, id_col, text_col))
    members = crowded_lists(classes, lists, together, scratch)
    best = scratch.write(best_centres(members, classes, minimum, similarity, scratch))
    links = verified(best, docs, classes, similarity, width, id_col, text_col, scratch)
    clusters = with_roots(classes.select("key"), tree_roots(best, scratch), "key").withColumnRenamed("root", "cluster")
    rooted = scratch.write(with_roots(clusters, tree_roots(links, scratch), "key"))
    asked = asked_clusters(members, classes, rooted, minimum, similarity, scratch, block)
    more = across_components(asked, docs, classes, rooted, minimum, similarity, width, id_col, text_col, scratch, block)
    # The first links stand in the roots: what is left is to join those.
    of = rooted.select("key", "root")
    between = more.join(of.select(F.col("key").alias("a"), F.col("root").alias("u")), "a").join(of.select(F.col("key").alias("b"), F.col("root").alias("v")), "b")
    joined = with_roots(rooted.select(F.col("root").alias("old")).distinct(), components(between.select(F.col("u").alias("a"), F.col("v").alias("b")), cut=scratch.write), "old")
    found = classes.select("key", "first").join(of, "key").join(joined.select(F.col("old").alias("root"), F.col("root").alias("new")), "root")
    found = scratch.write(found.select("key", "first", F.col("new").alias("root")))
    scratch.remove(found)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicate texts."""
    found = text_groups(docs, id_col=id_col, text_col=text_col, **options)
    return keep_rows(docs, found.groupBy("root").agg(F.min("first").alias("first")), id_col, text_col)
