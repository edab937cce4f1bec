"""Language-model scoring: masked pseudo-likelihood from a small bidirectional window network.

Tokens are lower-cased words. Symbols of the network are the ``words`` most frequent words of the corpus (1,500) and
``BUCKETS`` classes (by length and last letters) for all others; id 0 is the edge of a text. Each token is predicted from
the symbols at its two sides: two branches, softmax(tanh(embedding of the neighbour) @ out + offset), one for each side,
and the symbols' frequencies are mixed by a gate that depends on how often the two neighbours stand in the corpus. A word
of a class adds log p(word | class) from its count in all documents. A document's score is the sum over all its tokens.

    counting  Spark counts words, and then which symbol follows which, over all documents, combined in each task. The table
              of symbols has a size that parameters bound, whatever the corpus's size
    training  the branches are trained in numpy on those counts, each weighted by its number, with Adam: as if on every
              window of the corpus, without reading it again
    gate      one pass over all documents sums, for each pair of frequency classes of the neighbours, how much of its tokens
              each of the three predictions explains (a step of expectation maximisation); Spark adds the sums
    scoring   one pass: the branches are told as tables of log-probabilities, the next ``listed`` words (200,000) with their
              counts, all other words are joined with theirs

Words that the corpus does not hold share the weight of the words that stand once in their class (Good and Turing), at
six bits a letter.

Defined results: null and empty texts have no tokens, score 0.0 and a null mean. Rows that repeat count and score as rows
of their own. Extra columns are not carried. Words over ``LONGEST`` bytes are of classes, and joined. An empty corpus
leaves the network near uniform; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.bpe import top_counts
from inkstone.llm.columns import id_and_text, slices
from inkstone.runtime import cut_lineage

BUCKETS = 256
EDGE = 0
LONGEST = 64
LEVELS = 8  # frequency classes of a neighbour
LETTER = 6 * math.log(2)


class TokenIds(dict):
    """Ids of words; words outside the vocabulary are classed when first met. ``trim`` bounds what is kept.

    ``listed`` words of classes have ids of their own behind those of the symbols.
    """

    def __init__(self, words: list[str], listed: list[str] = ()):
        self.fixed = {w: i for i, w in enumerate(words, 1)}
        self.first = len(words) + 1
        self.fixed.update(zip(listed, range(self.size, self.size + len(listed)), strict=True))
        super().__init__(self.fixed)

    def __missing__(self, word: str) -> int:
        found = self[word] = self.class_of(word)
        return found

    def class_of(self, word: str) -> int:
        return self.first + 32 * (min(len(word) - 1, 15) // 2) + zlib.crc32(word[-2:].encode()) % 32

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()
            self.update(self.fixed)

    @property
    def size(self) -> int:
        return self.first + BUCKETS


def edged(texts: list[str], ids: TokenIds) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each between two edges, and the number of words of each."""
    ids.trim()
    split = [t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    codes = np.fromiter((ids[w] for words in split for w in words), np.int64, int(lengths.sum()))
    out = np.full(len(codes) + 2 * len(split), EDGE, np.int64)
    out[np.arange(len(codes)) + np.repeat(2 * np.arange(len(split)) + 1, lengths)] = codes
    return out, lengths


def windows(lengths: np.ndarray) -> np.ndarray:
    """The places of the words in ``edged`` ids, of texts of so many words."""
    return np.arange(lengths.sum()) + np.repeat(2 * np.arange(len(lengths)) + 1, lengths)


def pair_counts(plain: DataFrame, words: list[str], most: int = 2_000_000) -> DataFrame:
    """``pair, n``: how often a symbol follows another in a text (``pair`` is the first's number times the symbols, plus the
    second's), edges included; a task holds about ``most`` pairs at once."""

    def run(batches):
        ids, held = TokenIds(words), []

        def told():
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

        for batch in slices(batches):
            out, lengths = edged(batch.column(1).to_pylist(), ids)
            inner = windows(lengths)
            ends = np.cumsum(lengths + 2) - 1
            firsts = np.concatenate((out[inner - 1] * ids.size + out[inner], out[ends[lengths > 0] - 1] * ids.size + EDGE))
            held.append(np.unique(firsts, return_counts=True))
            if sum(len(k) for k, _ in held) > most:
                yield told()
        if held:
            yield told()

    return plain.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def word_counts(plain: DataFrame, most: int = 300_000) -> DataFrame:
    """``word, count`` over all documents; a task holds about ``most`` words at once."""

    def run(batches):
        found = Counter()

        def told():
            rows = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return rows

        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                found.update(text.lower().split())
            if len(found) > most:
                yield told()
        yield told()

    return plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))


def class_totals(counted: DataFrame, words: list[str]) -> np.ndarray:
    """For each symbol of ``words`` and the classes: tokens, and words that stand once."""

    def run(batches):
        ids = TokenIds(words)
        total = np.zeros((2, ids.size), np.int64)
        for batch in batches:
            ids.trim()
            at = np.fromiter(map(ids.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            n = batch.column(1).to_numpy()
            np.add.at(total[0], at, n)
            np.add.at(total[1], at[n == 1], 1)
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (there, total[0, there], total[1, there])], ["id", "n", "once"])

    sums = counted.select("word", "count").mapInArrow(run, "id long, n long, once long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))
    out = np.zeros((2, TokenIds(words).size), np.int64)
    for r in sums.collect():
        out[:, r.id] = r.n, r.once
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class Branch:
    """One side of the network: softmax(tanh(embedding of a neighbour) @ out + offset)."""

    embedding: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, frequency: np.ndarray, hidden: int, rng: np.random.Generator) -> Branch:
        size = len(frequency)
        return cls(*(x.astype(np.float32) for x in (rng.normal(0, 0.1, (size, hidden)), rng.normal(0, 0.1, (hidden, size)), np.log(frequency))))

    def probabilities(self, rows=slice(None)) -> np.ndarray:
        return _softmax(np.tanh(self.embedding[rows]) @ self.out + self.offset)

    def gradients(self, rows: np.ndarray, counts: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over windows, and its gradients, for neighbours ``rows`` with a row of token counts each."""
        h, n = np.tanh(self.embedding[rows]), counts.sum(axis=1, keepdims=True)
        p = _softmax(h @ self.out + self.offset)
        total = max(float(n.sum()), 1.0)
        loss = -float((counts * np.log(np.maximum(p, 1e-30))).sum()) / total
        d = (p * n - counts) / total
        return loss, [(d @ self.out.T) * (1 - h * h), h.T @ d, d.sum(axis=0)]

    def train(self, counts: np.ndarray, rng: np.random.Generator, epochs: int = 40, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam over mini-batches of neighbours, each weighted by its windows; steps shrink to nothing."""
        parameters = [self.embedding, self.out, self.offset]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        seen = np.flatnonzero(counts.sum(axis=1))
        steps = epochs * -(-len(seen) // batch)
        for epoch in range(epochs):
            mix = rng.permutation(seen)
            for at in range(0, len(mix), batch):
                rows = mix[at : at + batch]
                step = epoch * -(-len(seen) // batch) + at // batch + 1
                _, grads = self.gradients(rows, counts[rows])
                for k, (p, g) in enumerate(zip(parameters, grads, strict=True)):
                    where = rows if k == 0 else slice(None)
                    g = g + decay * p[where] / len(seen) if k < 2 else g
                    first[k][where] = 0.9 * first[k][where] + 0.1 * g
                    second[k][where] = 0.99 * second[k][where] + 0.01 * g * g
                    p[where] -= rate * (1 - step / (steps + 1)) * (first[k][where] / (1 - 0.9**step)) / (np.sqrt(second[k][where] / (1 - 0.99**step)) + 1e-9)


@dataclass
class Network:
    """The branches as tables of probabilities [neighbour, token], the symbols' frequencies, and the gate's weights by the
    frequency classes of the two neighbours."""

    left: np.ndarray
    right: np.ndarray
    frequency: np.ndarray
    level: np.ndarray
    gate: np.ndarray

    def parts(self, l: np.ndarray, r: np.ndarray, token: np.ndarray) -> np.ndarray:  # noqa: E741
        """The three predictions of each window's token, weighted by the gate."""
        each = np.stack((self.left[l, token], self.right[r, token], self.frequency[token]), axis=1).astype(np.float64)
        return each * self.gate[self.level[l], self.level[r]]

    def log_prob(self, l: np.ndarray, r: np.ndarray, token: np.ndarray) -> np.ndarray:  # noqa: E741
        """Log-probability of the token of each window."""
        return np.log(self.parts(l, r, token).sum(axis=1))

    def table(self) -> np.ndarray:
        """Probabilities [left, right, token]; for small vocabularies."""
        g = self.gate[self.level[:, None], self.level[None, :]]
        return g[..., :1] * self.left[:, None] + g[..., 1:2] * self.right[None] + g[..., 2:] * self.frequency


def shares(plain: DataFrame, words: list[str], network: Network) -> np.ndarray:
    """How much of the tokens of all documents each prediction explains, by the frequency classes of the neighbours."""
    shared = plain.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        ids, total = TokenIds(words), np.zeros((LEVELS * LEVELS, 3))
        for batch in slices(batches):
            out, lengths = edged(batch.column(1).to_pylist(), ids)
            at = windows(lengths)
            parts = shared.value.parts(out[at - 1], out[at + 1], out[at])
            parts /= parts.sum(axis=1, keepdims=True)
            cell = shared.value.level[out[at - 1]] * LEVELS + shared.value.level[out[at + 1]]
            for k in range(3):
                total[:, k] += np.bincount(cell, parts[:, k], LEVELS * LEVELS)
        there = np.flatnonzero(total.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.array(total[there, k]) for k in range(3)]], ["cell", "s0", "s1", "s2"])

    sums = plain.mapInArrow(run, "cell long, s0 double, s1 double, s2 double").groupBy("cell").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)])
    total = np.zeros((LEVELS * LEVELS, 3))
    for r in sums.collect():  # at most LEVELS ** 2 rows
        total[r.cell] = r.s0, r.s1, r.s2
    shared.unpersist()
    return total.reshape(LEVELS, LEVELS, 3)


@dataclass
class Scorer:
    words: list[str]
    network: Network
    totals: np.ndarray
    counted: DataFrame
    listed: list[tuple[str, int]]  # the most frequent words of classes with their counts; all others are joined


def fit(docs: DataFrame, words: int = 1_500, hidden: int = 48, listed: int = 200_000, epochs: int = 40, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A network of the whole corpus, and the counts of all its words."""
    plain = id_and_text(docs, id_col, text_col)
    counted = cut_lineage(word_counts(plain))
    frequent = top_counts(counted.where((F.col("count") > 1) & (F.octet_length("word") <= LONGEST)), words + listed)
    vocabulary = sorted(w for w, _ in frequent[:words])
    totals, size, rng = class_totals(counted, vocabulary), TokenIds(vocabulary).size, np.random.default_rng(seed)
    pairs = pair_counts(plain, vocabulary).toArrow()  # at most as many as symbols, squared
    follows = np.zeros((size, size), np.float32)
    follows[np.divmod(pairs["pair"].to_numpy(), size)] = pairs["n"].to_numpy()
    frequency = (totals[0] + 0.1) / (totals[0] + 0.1).sum()
    frequency[EDGE] = 1e-12
    frequency /= frequency.sum()
    tables = []
    for counts in (follows, follows.T.copy()):
        counts[:, EDGE] = 0  # an edge is a neighbour, but is not predicted
        branch = Branch.start(frequency, hidden, rng)
        branch.train(counts, rng, epochs)
        tables.append(branch.probabilities().astype(np.float32))
    near = follows.sum(axis=1)
    level = np.clip(np.log2(near + 1) / max(np.log2(near.max() + 1), 1) * LEVELS, 0, LEVELS - 1).astype(np.int64)
    network = Network(*tables, frequency.astype(np.float32), level, np.full((LEVELS, LEVELS, 3), 1 / 3))
    explained = shares(plain, vocabulary, network) + 1.0
    network.gate = explained / explained.sum(axis=2, keepdims=True)
    return Scorer(vocabulary, network, totals, counted, frequent[words:])


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of each text."""
    plain = id_and_text(docs, id_col, text_col)
    shared = plain.sparkSession.sparkContext.broadcast((scorer.words, scorer.listed, scorer.network))
    n, once = scorer.totals.astype(float)
    unseen = (once + 1 / (n + 1)) / (n + 1)  # the share of a class that is left to words the corpus does not hold
    per_word = np.log1p(-np.minimum(unseen, 1 - 1e-12)) - np.log(np.maximum(n, 1))
    first = len(scorer.words) + 1

    def run(batches):
        words, listed, network = shared.value
        ids = TokenIds(words, [w for w, _ in listed])
        symbols = np.concatenate((np.arange(ids.size), np.fromiter((ids.class_of(w) for w, _ in listed), np.int64, len(listed))))
        own = np.zeros(len(symbols))  # log p(word | class) of listed words
        own[ids.size :] = np.log(np.array([k for _, k in listed], float)) + per_word[symbols[ids.size :]]
        for batch in slices(batches):
            ids.trim()
            split = [t.lower().split() for t in batch.column(1).to_pylist()]
            lengths = np.array([len(w) for w in split], np.int64)
            every = [w for words in split for w in words]
            codes = np.fromiter(map(ids.__getitem__, every), np.int64, len(every))
            symbol = np.full(len(codes) + 2 * len(split), EDGE, np.int64)  # each text between two edges
            at = windows(lengths)
            symbol[at] = symbols[codes]
            logp = network.log_prob(symbol[at - 1], symbol[at + 1], symbol[at]) + own[codes]
            of_text = np.repeat(np.arange(len(split)), lengths)
            total = np.bincount(of_text, logp, len(split)).astype(float)
            rare = np.flatnonzero((codes >= ids.first) & (codes < ids.size))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of_text[rare], minlength=len(split)))))
            entries = pa.StructArray.from_arrays([pa.array([every[i] for i in rare.tolist()], pa.string()), pa.array((codes[rare] - ids.first).astype(np.int16))], ["word", "kind"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(total, pa.float64()), lists], ["doc_id", "n_tokens", "of_symbols", "rare"])

    found = plain.mapInArrow(run, "doc_id long, n_tokens long, of_symbols double, rare array<struct<word:string,kind:smallint>>")
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode("rare").alias("x")).groupBy("row", "x").agg(F.count("*").alias("times")).select("row", "x.word", "x.kind", "times")
    of_kind = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values[first:]]), F.col("kind") + 1)
    known = F.log("count") + of_kind(per_word)
    one = F.coalesce(known, of_kind(np.log(unseen)) - LETTER * F.length("word"))
    sums = each.join(scorer.counted, "word", "left").groupBy("row").agg(F.sum(one * F.col("times")).alias("of_words"))
    told = found.drop("rare").join(sums, "row", "left").withColumn("log_prob", F.col("of_symbols") + F.coalesce("of_words", F.lit(0.0)))
    return told.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
