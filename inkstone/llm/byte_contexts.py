"""Language identification by prediction by partial matching (PPM): exact code lengths under byte context trees.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. In a context seen N times with d distinct followers, a
follower seen n times has probability n / (N + d); any other byte escapes with d / (N + d) to the context without its
first byte, and in the end to one of 256 equal bytes. A text's code length under a language is the sum over its bytes,
in whole 65536ths of a bit, so sums are exact and depend on no order. The language with the shortest code wins, that of
naming the language (its share of the training documents) included.

Statistics are frozen after training: Spark counts, over all training documents, how often each byte follows each context
of ``ORDER`` bytes; shorter contexts are sums of those. A text starts behind ``ORDER`` line ends, so every byte has a
whole context. The counts that go to the tasks are bounded: of all (language, context, byte) entries those that are seen
at least ``least`` times stay, where ``least`` is the smallest step (64 for each power of two) for which the model has at
most ``cells`` costs (entries times languages). More than ``languages`` languages are an error.

For scoring, the tree is closed: for every entry of any language the code lengths under all languages are worked out
beforehand, with their escapes. So nearly all bytes cost one search in a sorted array, whatever the number of languages.

Defined results: null texts and those without a letter are ``und`` with score 0. The score is the probability of the
predicted language given the text. Ties go to the smallest name. A null doc_id belongs to the training fold. Rows that
repeat get equal results. Very long texts are worked through in pieces. Extra columns stay behind. Without training
documents every text is ``und`` with score 0; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import slices
from inkstone.llm.quality_model import held_out
from inkstone.runtime import Scratch

ORDER = 4
UNIT = 65536  # parts of a bit
START = 10  # the byte that stands before a text, ``ORDER`` times
PIECE = 1 << 20
UNDECIDED = "und"


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings, each string behind ``ORDER`` line ends, and where each string's bytes start."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + ORDER * np.arange(1, len(column) + 1)
    out = np.full(len(data) + ORDER * len(column), START, np.uint8)
    out[np.arange(len(data)) + ORDER * np.repeat(np.arange(1, len(column) + 1), sizes)] = data
    return out, starts


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte after the first ``ORDER`` with the ``ORDER`` bytes before it, as one number; the byte stands last."""
    found = np.zeros(max(len(data) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        found = found << 8 | data[k : len(data) - ORDER + k]
    return found


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 2_000_000) -> DataFrame:
    """``lang, gram, n``: how often each byte follows each whole context, by language, over all rows; a task adds up what
    it has seen before it tells it, and holds at most about ``most`` entries of a language."""

    def run(batches):
        held: dict[str, list] = {}

        def told(lang):
            keys, counts = _merged(*map(np.concatenate, zip(*held.pop(lang), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for batch in slices(batches, rows=4096):
            langs = batch.column(1).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                data, starts = padded(batch.column(0).filter(pa.compute.equal(langs.indices, code)))
                wanted = np.ones(len(data), bool)
                wanted[(starts[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
                for at in range(0, len(data) - ORDER, PIECE):
                    piece = data[at : at + PIECE + ORDER]
                    keys = grams(piece)[wanted[at + ORDER : at + len(piece)]]
                    keys, counts = np.unique(keys, return_counts=True)
                    held.setdefault(lang, []).append((keys, counts.astype(np.int64)))
                    if sum(len(k) for k, _ in held[lang]) > most:
                        held[lang] = [_merged(*map(np.concatenate, zip(*held[lang], strict=True)))]
                        if len(held[lang][0][0]) > most // 2:
                            yield told(lang)
        for lang in list(held):
            yield told(lang)

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Code lengths by order of context: ``keys[d]`` are sorted contexts of d bytes with their follower, ``costs[d]`` what
    the follower costs each language, escapes included; ``contexts[d]`` and ``escapes[d]`` what leaving the context costs."""

    langs: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: list[np.ndarray] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    def of_grams(self, found: np.ndarray) -> np.ndarray:
        """Code lengths of bytes with their whole contexts, a row for each and a column for each language."""
        total = np.zeros((len(found), len(self.langs)), np.int64)
        left = np.arange(len(found))
        for order in range(ORDER, -1, -1):
            sought = found[left] & ((1 << 8 * (order + 1)) - 1)
            at, known = _sought(self.keys[order], sought)
            total[left[known]] += self.costs[order][at[known]]
            left, sought = left[~known], sought[~known]
            at, known = _sought(self.contexts[order], sought >> 8)
            total[left[known]] += self.escapes[order][at[known]]
        total[left] += 8 * UNIT
        return total

    def of_texts(self, column: pa.Array) -> np.ndarray:
        """Code lengths of texts, without that of naming the language."""
        data, starts = padded(column)
        total = np.zeros((len(column), len(self.langs)), np.int64)
        inside = np.zeros(len(data), np.int64)
        inside[starts - ORDER] = 1
        owner = np.cumsum(inside) - 1
        pads = np.zeros(len(data), bool)
        pads[(starts[:, None] - np.arange(1, ORDER + 1)).ravel()] = True
        for at in range(0, len(data) - ORDER, PIECE):
            piece = data[at : at + PIECE + ORDER]
            costs = self.of_grams(grams(piece))
            costs[pads[at + ORDER : at + len(piece)]] = 0
            of = owner[at + ORDER : at + len(piece)]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            total[of[first]] += np.add.reduceat(costs, first, axis=0)
        return total


def _sought(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted ``keys`` hold each of ``wanted``, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _bits(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(part / whole) * UNIT).astype(np.int64)


def close_trees(langs: list[str], documents: list[int], entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The model of counts: for each order of context the (language's place, context and follower, count) that are kept."""
    model = Model(langs, _bits(np.array(documents, float), float(sum(documents))) if langs else np.zeros(0, np.int64))
    for order, (lang, gram, n) in enumerate(entries):
        keys, contexts = np.unique(gram), np.unique(gram >> 8)
        seen, distinct = np.zeros((2, len(contexts), len(langs)))
        at = np.searchsorted(contexts, gram >> 8)
        np.add.at(seen, (at, lang), n)
        np.add.at(distinct, (at, lang), 1)
        known = distinct > 0
        escapes = np.where(known, _bits(np.where(known, distinct, 1), np.where(known, seen + distinct, 1)), 0)
        shorter, found = _sought(model.keys[-1], keys & ((1 << 8 * order) - 1)) if order else (None, None)
        below = model.costs[-1][shorter] if order else np.full((len(keys), len(langs)), 8 * UNIT)
        assert order == 0 or found.all()  # a context holds at least what a longer one that ends with it holds
        costs = escapes[np.searchsorted(contexts, keys >> 8)] + below
        costs[np.searchsorted(keys, gram), lang] = _bits(n, (seen + distinct)[at, lang])
        model.keys.append(keys)
        model.costs.append(costs.astype(np.int32))
        model.contexts.append(contexts)
        model.escapes.append(escapes.astype(np.int32))
    return model


def fit(docs: DataFrame, cells: int = 8_000_000, languages: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trees of the documents that have a language and are not held out."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    training = docs.where(F.col("lang").isNotNull() & ~held_out())
    shares = sorted((r.lang, r.n) for r in training.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect())
    if len(shares) > languages:
        raise ValueError(f"more than {languages} languages")
    if not shares:
        return Model()
    scratch = Scratch(docs.sparkSession, "byte-contexts")
    whole = scratch.write(count_grams(training))
    suffixes = F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda d: F.struct(d.alias("d"), F.col("gram").bitwiseAND(F.element_at(F.array(*[F.lit((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]), d + 1)).alias("g")))
    levels = whole.select("lang", F.inline(suffixes), "n").groupBy("lang", "d", "g").agg(F.sum("n").alias("n"))
    levels = scratch.write(levels)
    room, least = cells // len(shares), None
    step = F.greatest(F.lit(0), F.floor(F.log2("n")).cast("int") - 6)  # counts in 64 steps for each power of two: few rows
    edges = levels.withColumn("step", step).selectExpr("shiftleft(shiftright(n, step), step) as edge")
    for edge, entries in edges.groupBy("edge").agg(F.count("*").alias("entries")).orderBy(F.desc("edge")).collect():
        room -= entries
        if room < 0:
            break
        least = edge
    kept = levels.where(F.col("n") >= F.lit(least).cast("long")).toArrow()
    place = {lang: k for k, (lang, _) in enumerate(shares)}
    lang = np.array([place[x] for x in kept["lang"].to_pylist()], np.int64)
    order, gram, n = (kept[c].to_numpy().astype(np.int64) for c in ("d", "g", "n"))
    scratch.remove()
    return close_trees([x for x, _ in shares], [n for _, n in shares], [(lang[m], gram[m], n[m]) for m in (order == d for d in range(ORDER + 1))])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            texts = batch.column(1)
            known = np.array([any(map(str.isalpha, t)) for t in texts.to_pylist()], bool) & bool(model.langs)
            names, scores = np.full(batch.num_rows, UNDECIDED, object), np.zeros(batch.num_rows)
            if known.any():
                lengths = model.of_texts(texts.filter(pa.array(known))) + model.prior
                best = lengths.min(axis=1, keepdims=True)
                names[known] = np.array(model.langs, object)[lengths.argmin(axis=1)]
                scores[known] = 1 / np.exp2((best - lengths) / UNIT).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
