"""Phrase collocations by relational set mining (SETM): occurrence relations grow by one word at a time.

The relation of length m holds where phrases of m words that are frequent in their language stand: a row for each document
(or part of one, see below) with sorted positions and, beside them, the identifiers of the phrases. Between two pieces a
position is left out, so neighbouring positions are neighbouring words of one piece. One round makes length m + 1:

    merge-join   the sorted relation meets itself at the next position: two frequent phrases that overlap in all but one
                 word make a candidate. The rows are sorted and whole, so this is a scan of two pointers in each task
    group-count  candidates are counted in each task, then by Spark; those seen ``least`` times stay and get identifiers
    semi-join    occurrences whose candidate stayed are the next relation, written to the shared folder

The semi-join looks candidates up in sorted arrays on the tasks if at most ``told`` phrases are frequent, else it is a
shuffled join of single occurrences; both give the same. Phrases carry the counts of all their beginnings and ends, from
which scores follow in exact decimals. The first ``most`` of each language are found by one sort over all languages and
running counts, so no language is ranked in one task.

Words are grouped as strings; positions of words are found through 64-bit hashes, and a count makes sure that no frequent
word shares its hash with any other word of the corpus (another seed is taken if one does). Parts: a document of more than
``block`` words and breaks is cut; each part also sees the next words, and counts the phrases that begin in it.

Defined results: null texts are empty and null languages ``und``. Repeated rows count as often as they stand. Texts without
words and empty tables give no rows. Ties in score and count go by the phrase's bytes. Very long texts are cut as above,
whole. Extra columns stay behind.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.columns import slices
from inkstone.runtime import Scratch, setting

BLOCK = 1 << 20
BATCH = 256  # rows
LONGEST = 5
BREAKS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(BREAKS + b"\t" + bytes(range(65, 91)), b"\n" * len(BREAKS) + b" " + bytes(range(97, 123)))
RELATION = "doc long, part int, until int, at array<int>, a array<long>, b array<long>"


def tokens(text: str) -> list[bytes]:
    """Words and, as a line end, breaks between pieces."""
    return [t for t in text.encode().translate(_CLEAN).replace(b"\n", b" \n ").split(b" ") if t]


def _seed(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


def texts_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc, lang, text`` with a number for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(text, F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).select(F.monotonically_increasing_id().alias("doc"), "lang", "text")


def count_words(texts: DataFrame, seed: int, most: int = 300_000) -> DataFrame:
    """``lang, word, h, n`` of every word; a task adds up about ``most`` words before it tells them."""

    def run(batches):
        held: dict[str, Counter] = {}

        def told():
            for lang, words in held.items():
                words.pop(b"\n", None)
                names = list(words)
                hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=_seed(lang, seed)), names), np.uint64, len(names)).view(np.int64)
                columns = [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(hashes), pa.array(list(words.values()), pa.int64())]
                yield from slices([pa.RecordBatch.from_arrays(columns, ["lang", "word", "h", "n"])], rows=65_536)
            held.clear()

        for batch in slices(batches, chars=1_000_000):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > most:
                yield from told()
        yield from told()

    return texts.select("lang", "text").mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


class Occurrences:
    """Occurrences of candidates in some rows: which row, where, and the two keys of each; ``until`` by row."""

    def __init__(self, doc, part, until, row, at, a, b):
        self.doc, self.part, self.until, self.row, self.at, self.a, self.b = doc, part, until, row, at, a, b

    def only(self, keep: np.ndarray) -> Occurrences:
        return Occurrences(self.doc, self.part, self.until, self.row[keep], self.at[keep], self.a[keep], self.b[keep])

    def early(self, more: int) -> np.ndarray:
        """Which begin before ``until`` or less than ``more`` positions behind it."""
        return self.at < self.until[self.row] + more

    def batch(self) -> pa.RecordBatch:
        """As rows of the relation; rows of fewer than two occurrences cannot grow and are left out."""
        sizes = np.bincount(self.row, minlength=len(self.doc))
        stays = sizes >= 2
        inner = stays[self.row]
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[stays]))).astype(np.int32))
        nested = [pa.ListArray.from_arrays(offsets, pa.array(x[inner])) for x in (self.at.astype(np.int32), self.a, self.b)]
        flat = [pa.array(self.doc[stays]), pa.array(self.part[stays].astype(np.int32)), pa.array(self.until[stays].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*flat, *nested], ["doc", "part", "until", "at", "a", "b"])


def word_occurrences(batch: pa.RecordBatch, seed: int, block: int = BLOCK) -> Occurrences:
    """All words of ``doc, lang, text``; keys are the word's hash and 0."""
    docs, parts, until, rows, at, keys = [], [], [], [], [], []
    for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        found = tokens(text)
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=_seed(lang, seed)), found), np.uint64, len(found)).view(np.int64)
        places = np.flatnonzero(np.fromiter((t != b"\n" for t in found), bool, len(found)))
        for part, low in enumerate(range(0, len(found), block)):
            own = places[np.searchsorted(places, low) : np.searchsorted(places, low + block + LONGEST - 1)]
            rows.append(np.full(len(own), len(docs)))
            at.append(own)
            keys.append(hashes[own])
            docs.append(doc)
            parts.append(part)
            until.append(low + block)
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    keys = joined(keys)
    return Occurrences(np.array(docs, np.int64), np.array(parts, np.int64), np.array(until, np.int64), joined(rows), joined(at), keys, np.zeros(len(keys), np.int64))


def grown_occurrences(batch: pa.RecordBatch) -> Occurrences:
    """The merge-join of relation rows with themselves at the next position; ``a`` and ``b`` are the two phrases."""
    doc, part, until = (batch.column(k).to_numpy() for k in range(3))
    sizes = np.diff(batch.column(3).offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    at, item = (batch.column(k).flatten().to_numpy() for k in (3, 4))
    first = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1))
    return Occurrences(doc, part, until, row[first], at[first].astype(np.int64), item[first], item[first + 1])


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n


def count_pairs(relation: DataFrame, least: int, most: int = 500_000) -> DataFrame:
    """``a, b, n`` of candidates that are seen ``least`` times; a task adds up ``most`` occurrences before it tells them."""

    def run(batches):
        held: list[tuple] = []

        def told():
            found = _counted(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            yield from slices([pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "n"])], rows=65_536)

        for batch in slices(batches, chars=1_000_000):
            found = grown_occurrences(batch)
            found = found.only(found.early(0))
            held.append((found.a, found.b, np.ones(len(found.a), np.int64)))
            if sum(len(x[0]) for x in held) > most:
                yield from told()
        if held:
            yield from told()

    return relation.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Lookup:
    """Identifiers of pairs of keys. Pairs are sorted by a mix of both keys under which no two of them are the same."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray):
        self.odd = np.uint64(0x9E3779B97F4A7C15)
        while True:
            mixes = self._mix(a, b)
            order = np.argsort(mixes)
            if not np.any(np.diff(mixes[order]) == 0):
                break
            self.odd += np.uint64(2)
        self.mixes, self.a, self.b, self.ids = mixes[order], a[order], b[order], ids[order]

    def _mix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.view(np.uint64) * self.odd + b.view(np.uint64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is there, and the identifiers of those that are."""
        if not len(self.ids):
            return np.zeros(len(a), bool), self.ids
        at = np.minimum(np.searchsorted(self.mixes, self._mix(np.ascontiguousarray(a), np.ascontiguousarray(b))), len(self.ids) - 1)
        known = (self.a[at] == a) & (self.b[at] == b)
        return known, self.ids[at[known]]


def semi_join(rows: DataFrame, occurrences, frequent: DataFrame, length: int, told: int) -> DataFrame:
    """The relation of phrases of ``length`` words: occurrences in ``rows`` whose keys ``frequent`` (``a, b, id``) has."""
    more = LONGEST - length

    def candidates(batch):
        found = occurrences(batch)
        return found.only(found.early(more))

    if frequent.count() <= told:
        kept = frequent.select("a", "b", "id").toArrow()
        shared = rows.sparkSession.sparkContext.broadcast(Lookup(*(kept[c].to_numpy() for c in ("a", "b", "id"))))

        def run(batches):
            for batch in slices(batches, chars=1_000_000):
                found = candidates(batch)
                known, ids = shared.value.find(found.a, found.b)
                found = found.only(known)
                found.a, found.b = ids, np.zeros(len(ids), np.int64)
                yield found.batch()

        return rows.mapInArrow(run, RELATION).drop("b")

    def nested(batches):
        for batch in slices(batches, chars=1_000_000):
            yield candidates(batch).batch()

    single = rows.mapInArrow(nested, RELATION).select("doc", "part", "until", F.inline(F.arrays_zip("at", "a", "b")))
    joined = single.join(frequent.select("a", "b", "id"), ["a", "b"]).groupBy("doc", "part", "until").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("x"))
    return joined.where(F.size("x") >= 2).select("doc", "part", "until", F.col("x.at").alias("at"), F.col("x.id").alias("a"))


def longer(counted: DataFrame, level: DataFrame) -> DataFrame:
    """Phrases of one word more: ``counted`` pairs with what ``level`` knows of their two phrases."""
    head = level.select(F.col("id").alias("a"), "lang", "phrase", "heads")
    tail = level.select(F.col("id").alias("b"), "last", "tails")
    both = counted.join(head, "a").join(tail, "b")
    return both.select("a", "b", "id", "lang", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", F.array_append("heads", F.col("n")).alias("heads"), F.array_append("tails", F.col("n")).alias("tails"), "n")


def best_cut(heads: Column, tails: Column, n: Column, words: Column, scale: int = 1000) -> Column:
    """``score, k, l, r`` of the cut with the lowest score; ``heads`` and ``tails`` hold the counts of a phrase's first and
    last words by their number. Exact while counts stay below 10 ** 15 and the language below 10 ** 18 words."""
    exact = lambda x, digits: x.cast(f"decimal({digits},0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at(heads, k), F.element_at(tails, F.size(tails) - k)
        score = F.call_function("div", exact(n * scale, 19) * exact(words, 18), exact(l, 18) * exact(r, 18))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(heads) - 1), cut))


def first_of_each(rows: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """``rank`` and the first ``most`` rows of each language by score, count and phrase, from one sort over all rows."""
    ordered = rows.orderBy("lang", F.desc("score"), F.desc("a"), "phrase").withColumn("place", F.monotonically_increasing_id())
    placed = scratch.write(ordered).withColumn("run", F.shiftright("place", 33))
    runs = placed.groupBy("lang", "run").agg(F.count("*").alias("size"), F.min("place").alias("start"))
    earlier = Window.partitionBy("lang").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("lang", "run", "start", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    ranked = placed.join(runs, ["lang", "run"]).withColumn("rank", F.col("before") + F.col("place") - F.col("start") + 1)
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = 100, most: int = 2000, told: int = 2_000_000, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``most`` phrases."""
    # A batch of Spark's usual 10,000 rows holds 40 MB of a relation, in the executor and again in its Python worker.
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        return _mine(docs, least, most, told, block, text_col, lang_col)


def _mine(docs: DataFrame, least: int, most: int, told: int, block: int, text_col: str, lang_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "phrases")
    texts, seed = texts_of(docs, text_col, lang_col), 0
    while True:
        words = scratch.write(count_words(texts, seed))
        level = words.where(F.col("n") >= least)
        if words.join(level.select("h").distinct(), "h", "left_semi").count() == level.count():
            break
        seed += 1
    level = level.select(F.col("h").alias("a"), F.lit(0).cast("long").alias("b"), F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("heads"), F.array("n").alias("tails"), "n")
    level = scratch.write(level)
    relation = scratch.write(semi_join(texts, lambda batch: word_occurrences(batch, seed, block), level, 1, told))
    chosen = None
    for length in range(2, LONGEST + 1):
        counted = scratch.write(count_pairs(relation, least).withColumn("id", F.monotonically_increasing_id()))
        above = scratch.write(longer(counted, level))
        if length > 2:
            chosen = _outlived(level, above) if chosen is None else chosen.unionByName(_outlived(level, above))
        level = above
        if length < LONGEST:
            relation = scratch.write(semi_join(relation, grown_occurrences, level, length, told))
    chosen = chosen.unionByName(level)
    sums = words.groupBy("lang").agg(F.sum("n").alias("words"))
    cut = best_cut(F.col("heads"), F.col("tails"), F.col("n"), F.col("words"))
    scored = chosen.join(sums, "lang").withColumn("cut", cut)
    scored = scored.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")
    found = scratch.write(first_of_each(scored, scratch, most))
    scratch.remove(found)
    return found


def _outlived(level: DataFrame, above: DataFrame) -> DataFrame:
    """Phrases that no phrase of one word more holds as often. Whatever longer phrase does, one of those inside does too."""
    ends = above.select(F.explode(F.array("a", "b")).alias("id"), "n").groupBy("id").agg(F.max("n").alias("longer"))
    return level.join(ends, "id", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).drop("longer")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GROWN = ", ".join(
    f"""o{m} as (select o.doc, o.lang, o.piece, o.pos, o.phrase || ' ' || w.word as phrase from o{m - 1} o join c{m - 1} c on c.lang = o.lang and c.phrase = o.phrase
      join o w on w.doc = o.doc and w.piece = o.piece and w.pos = o.pos + {m - 1}),
    c{m} as (select lang, phrase, count(*) as n from o{m} group by all having count(*) >= 100)"""
    for m in range(2, LONGEST + 1)
)
_CUTS = " union all ".join(
    f"select lang, phrase, n as a, {m} as m, {k} as k, array_to_string(string_split(phrase, ' ')[:{k}], ' ') as head, array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') as tail from c{m}"
    for m in range(2, LONGEST + 1)
    for k in range(1, m)
)
_ALL = " union all ".join(f"select lang, phrase, n, {m} as m from c{m}" for m in range(1, LONGEST + 1))
ORACLE_SQL = rf"""with pieces as (select doc, lang, unnest(p) as t, generate_subscripts(p, 1) as piece from (
      select row_number() over () as doc, coalesce(lang, 'und') as lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') as p from documents)),
    o as (select doc, lang, piece, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc, lang, piece, regexp_extract_all(t, '[^\x20\x09]+') as w from pieces)),
    o1 as (select doc, lang, piece, pos, word as phrase from o), c1 as (select lang, phrase, count(*) as n from o1 group by all having count(*) >= 100), {_GROWN},
    every as ({_ALL}), cuts as ({_CUTS}), sums as (select lang, count(*) as words from o group by lang),
    scored as (select c.*, l.n as l, r.n as r, words, (1000::hugeint * c.a * words) // (l.n::hugeint * r.n) as score from cuts c join sums using (lang)
      join every l on l.lang = c.lang and l.phrase = c.head join every r on r.lang = c.lang and r.phrase = c.tail),
    lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as i from scored) where i = 1),
    free as (select * from lowest x where not exists (select 1 from every y where y.lang = x.lang and y.m > x.m and y.n >= x.a and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, words::bigint as n, score::bigint as score
    from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free) where rank <= 2000"""
