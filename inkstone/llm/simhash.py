"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most d bits agree in at least 8 - d of
their bytes: that is the guaranteed minimum number of matches. The index keys its lists by 7 - d byte positions together
(56 lists a fingerprint for d = 4), one less than the minimum: a list of one position would hold 1/256 of all documents.
In each list the shared positional bytes of its pairs are tallied, pairs below the minimum are refused by the count alone,
and the others are verified bit by bit. A pair that reaches the minimum meets in several lists, in each of which the same
is found. Lists hold distinct fingerprints, so copies of a text count once.

Lists of up to ``limit`` fingerprints are tallied inside a task, and give at most one link less than they have members. A
longer list is not compared pair by pair: each of its fingerprints probes all patterns within d/2 flipped bits, and those
that meet at a probe are linked to the smallest one there. Two fingerprints at distance d or less always meet at a probe
halfway, and all that meet are at distance d or less, so this is exact, and linear in the fingerprints.

Sizes of lists are counted with a combine before the shuffle. The join that fetches members deals a
list over as many salts as its size asks for. Components come
from alternating star contraction over checkpointed links; nothing about documents goes to the driver.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link like others. Rows with
equal text, or equal doc_id, keep their rows in ``near_duplicates``. A null doc_id gets its group's id, and null if the
group has no other. ``keep_one`` gives one row for each group, whatever its ids: unlike texts under one doc_id stay, and copies
without a doc_id go. Empty tables give no rows; extra columns stay out of ``near_duplicates`` and are carried by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import id_and_text, slices
from inkstone.runtime import cut_lineage


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash of a text's word shingles: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :])], np.uint64)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """``doc_id, fp``: each text's fingerprint as a signed 64-bit number; with ``hashed`` also ``text_hash``."""

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            more = [batch.column(2)] if hashed else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *more], ["doc_id", "fp", "text_hash"][: 2 + hashed])

    plain = id_and_text(docs, id_col, text_col)
    plain = plain.withColumn("text_hash", F.xxhash64("text")) if hashed else plain
    return plain.mapInArrow(run, "doc_id long, fp long" + ", text_hash long" * hashed)


def position_masks(shared: int = 4, positions: int = 8) -> list[int]:
    """One mask for each choice of ``shared`` byte positions, as signed numbers."""
    masks = [sum(0xFF << (8 * i) for i in c) for c in combinations(range(positions), shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def flip_masks(bits: int = 2, width: int = 64) -> list[int]:
    """All patterns of at most ``bits`` set bits, as signed numbers."""
    masks = [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(width), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _longs(values: list[int]):
    return F.lit(np.array(values, np.int64))


def retained_pairs(members: np.ndarray, one: int, others: np.ndarray, least: int) -> np.ndarray:
    """Which of ``others`` share at least ``least`` positional bytes with ``one`` (places in ``members``)."""
    bytes_of = members.view(np.uint8).reshape(-1, 8)
    return others[(bytes_of[others] == bytes_of[one]).sum(axis=1) >= least]


def list_edges(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links inside one inverted list that connect what all its close pairs connect: shared positional bytes are tallied
    for its pairs, those with the guaranteed minimum are retained and verified by their bits."""
    left = np.ones(len(members), bool)
    edges = []
    for start in range(len(members)):  # walk outwards from each member that is left, along close pairs
        front = [start] if left[start] else []
        left[start] = False
        while front:
            at = front.pop()
            likely = retained_pairs(members, at, np.flatnonzero(left), 8 - distance)
            near = likely[np.bitwise_count((members[likely] ^ members[at]).view(np.uint64)) <= distance]
            left[near] = False
            front += near.tolist()
            edges += [(int(members[at]), int(members[i])) for i in near]
    return edges


def links(fps: DataFrame, distance: int = 4, limit: int = 1024, most: int = 1000) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that join exactly the fingerprints which pairs at
    ``distance`` or less join."""
    shared = 7 - distance
    if not 0 < shared < 8 or distance % 2:
        raise ValueError("distance must be 2, 4 or 6")
    # Dealt anew first: fingerprints are small, so few partitions hold them, and each gives 56 rows. By a hash, since a
    # deal by fp itself would be left out as already there, and then coalesced.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = fps.repartition(parts, F.xxhash64("fp")).select("fp", F.posexplode(_longs(position_masks(shared))).alias("place", "mask"))
    # A list is named by a hash; should two lists share one, their pairs are tallied together, and refused all the same.
    lists = lists.select(F.xxhash64("place", F.col("fp").bitwiseAND(F.col("mask"))).alias("list"), "fp")
    sizes = cut_lineage(lists.groupBy("list").agg(F.count("*").alias("n")).where("n >= 2"))
    # A list has a salt for each ``most`` members; short lists have one, and stand in no table of salts.
    salts = sizes.where(F.col("n") > most).select("list", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    salted = lists.join(salts, "list", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    wanted = sizes.select("list", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1)).alias("salt"))
    # One plan at every size: the sizes grow with the documents, so they are never broadcast.
    members = cut_lineage(salted.join(wanted.hint("merge"), ["list", "salt"]).select("list", "fp", "n"))
    short = members.where(F.col("n") <= limit).groupBy("list").agg(F.collect_list("fp").alias("members"))

    def inside(batches):
        for batch in batches:
            found = {e for m in batch.column(0).to_pylist() for e in list_edges(np.array(m, np.int64), distance)}
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    near = short.select("members").mapInArrow(inside, "a long, b long")
    crowded = members.where(F.col("n") > limit).select("fp").distinct()
    probes = crowded.select("fp", F.explode(_longs(flip_masks(distance // 2))).alias("mask"))
    probes = probes.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("probe"), "fp")
    centres = probes.groupBy("probe").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("probe", "a")
    star = probes.join(centres, "probe").where("fp > a").select("a", F.col("fp").alias("b"))
    return near.unionAll(star).distinct()


def components(edges: DataFrame, rounds: int = 60, cut=cut_lineage) -> DataFrame:
    """``node, root``: the smallest node that each node of ``a, b`` links reaches.

    Each round hangs a node's larger neighbours on its smallest neighbour, then its smaller ones; trees become stars in
    a number of rounds that grows as the square of the logarithm of the nodes; more than ``rounds`` are an error. A node with very many neighbours is
    handled by a minimum (combined before the shuffle) and a join, never gathered. ``cut`` writes the links of a round and
    returns them as read back.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        now = cut(large.join(low, "u").select(hung.alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Number of links and a sum over them that tells one set of links from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_roots(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``nodes`` (distinct ``name``) with the root that ``components`` found, or themselves, as ``root``."""
    told = found.select(F.col("node").alias(name), "root").unionAll(found.select(F.col("root").alias(name), "root").distinct())
    return nodes.join(told, name, "left").withColumn("root", F.coalesce("root", name))


def roots(classes: DataFrame, distance: int, limit: int) -> DataFrame:
    """``classes`` (one row for each ``fp``) with the smallest fingerprint that links reach as ``root``."""
    return with_roots(classes, components(links(classes.select("fp"), distance, limit)), "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of each row; ``component_id`` is the smallest doc_id that links reach."""
    fps = cut_lineage(fingerprints(docs, width, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = cut_lineage(roots(classes, distance, limit))
    # Only groups of several fingerprints need the join; it is dealt over as many salts as the group asks for.
    grouped = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    grouped = cut_lineage(grouped.withColumn("salts", F.ceil(F.col("n") / 1000).cast("int")))
    salts = grouped.where("salts > 1").select("root", "salts")
    dealt = rooted.join(salts, "root", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    grouped = grouped.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    labels = dealt.join(grouped, ["root", "salt"], "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, distance: int = 4, width: int = 4, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest id (null is the greatest), then text hash."""
    fps = cut_lineage(fingerprints(docs, width, id_col, text_col, hashed=True))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    classes = fps.groupBy("fp").agg(F.min(order).alias("first"))
    return keep_rows(docs, roots(classes, distance, limit).groupBy("root").agg(F.min("first").alias("first")), id_col, text_col)


def keep_rows(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``first`` (doc_id and text_hash) names, each once."""
    first = first.select(F.col("first.doc_id").alias("__first"), F.col("first.text_hash").alias("__first_hash"))
    keyed = docs.withColumn("__id", F.col(f"`{id_col}`").cast("long"))
    keyed = keyed.withColumn("__hash", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    same = F.col("__id").eqNullSafe(F.col("__first")) & (F.col("__hash") == F.col("__first_hash"))
    return keyed.join(first, same, "left_semi").dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
