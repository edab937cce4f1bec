"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Fit: Spark counts the words of every document; the ``size`` most frequent ones are encoded once and compiled into a
minimal acyclic automaton (words with equal continuations share states). Each transition carries how many words lie
before it, so the sum along a path is the word's number, and that number addresses its ids. The automaton is three
sorted arrays in one file, which each Python worker maps into memory; ``size`` bounds it and what is broadcast.

Encode: a worker walks the automaton for all new words of a block of documents at once. A word that is not in it is
split and merged exactly, lowest rank first and leftmost among equals, all unseen pieces of the block side by side. Both
kinds are then kept in a table of bounded size. The lexicon therefore changes speed, never results.

Text rules of the word vocabulary: its special strings are cut out first; the rest is NFC-normalised, lower-cased code
point by code point and split at white space; a word splits into pieces by ``PIECES``; a piece's UTF-8 bytes are
written as byte letters, the last with the word-end mark. Decoding joins token strings by one space.

Defined results: null and empty texts have no ids and decode to the empty string. Rows with equal doc_id stay separate.
Extra columns are not carried. An empty table gives no rows; its lexicon is empty.
"""

from __future__ import annotations

import heapq
import json
import mmap
import tempfile
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import id_and_text, slices
from inkstone.runtime import cut_lineage

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Code points that Python's split() drops and the vocabulary's pattern keeps.
_KEPT_CONTROLS = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"(?:(?![\x1c-\x1f])\s)+")
_WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and special strings of a word-end BPE vocabulary file."""

    BASE = 1 << 20
    NEVER = 1 << 40

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.string())
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + _WORD_END] for c in letters]
        # The same merges for many pieces at once: pairs in order, and a table of the pairs of single bytes.
        pairs = np.array([a * self.BASE + b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made = np.zeros(len(spec["model"]["merges"]) + 1, np.int64)
        for rank, new in self.merges.values():
            self.made[rank] = new
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def merge(self, piece: bytes) -> list[int]:
        """Exact ids of one piece."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.final[piece[-1]]]
        if len(ids) > 24:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            found = [merges.get(pair) for pair in zip(ids, ids[1:])]  # noqa: B905
            best = min((m[0], i) for i, m in enumerate(found) if m) if any(found) else None
            if best is None:
                break
            at = best[1]
            ids[at : at + 2] = [found[at][1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: O(n log n)."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NEVER where it does not merge or a side is missing (-1)."""
        key = left * self.BASE + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], self.NEVER)

    def merge_many(self, pieces: list[bytes], block: int = 8192) -> list[bytes]:
        """Exact ids of each piece as 32-bit numbers: one merge in every open piece at a time."""
        out: list[bytes] = [b""] * len(pieces)
        by_size = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        inner, final = np.array(self.inner), np.array(self.final)
        for first in range(0, len(by_size), block):
            part = by_size[first : first + block]
            while part and len(pieces[part[-1]]) > 24:
                i = part.pop()
                out[i] = np.array(self.merge(pieces[i]), np.int32).tobytes()
            if not part:
                continue
            sizes = np.array([len(pieces[i]) for i in part])
            width = int(sizes[-1])
            letters = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            place = np.arange(width)
            ids = np.where(place < sizes[:, None], inner[letters], -1)
            rows = np.arange(len(part))
            ids[rows, sizes - 1] = final[letters[rows, sizes - 1]]
            done = np.full_like(ids, -1)
            ranks = np.full(ids.shape, self.NEVER)
            if width > 1:
                ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                at = ranks.argmin(axis=1)
                each = np.arange(len(rows))
                rank = ranks[each, at]
                open_ = rank < self.NEVER
                if not open_.all():
                    done[rows[~open_]] = ids[~open_]
                    rows, ids, ranks, at, rank = rows[open_], ids[open_], ranks[open_], at[open_], rank[open_]
                    each = each[: len(rows)]
                    if not len(rows):
                        break
                later = place > at[:, None]
                ids = np.where(later, np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1), ids)
                ranks = np.where(later, np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=self.NEVER), ranks)
                ids[each, at] = new = self.made[rank]
                after = np.where(at + 1 < width, ids[each, np.minimum(at + 1, width - 1)], -1)
                ranks[each, at] = self._ranks(new, after)
                has = at > 0
                ranks[each[has], at[has] - 1] = self._ranks(ids[each[has], at[has] - 1], new[has])
            whole = done >= 0
            flat = done[whole].astype(np.int32).tobytes()
            ends = np.cumsum(whole.sum(axis=1)).tolist()
            low = 0
            for i, high in zip(part, ends, strict=True):
                out[i] = flat[4 * low : 4 * high]
                low = high
        return out

    def pieces(self, word: str) -> list[str]:
        """The pieces of a normalised, whitespace-free word."""
        if word.isalpha():
            return [word]
        if word[-1] in ".,!" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return PIECES.findall(word)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one normalised, whitespace-free word."""
        return [i for piece in self.pieces(word) for i in self.merge(piece.encode())]

    def words(self, text: str) -> list[str]:
        """Normalised words of a text; a special string is the word of its upper-case letters, which no other word has."""
        if "<|" in text and len(parts := self.special_pattern.split(text)) > 1:
            return [w for i, part in enumerate(parts) for w in ([part.upper()] if i % 2 else _plain_words(part))]
        return _plain_words(text)

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Token strings of each list, joined by a space."""
        flat = self.tokens.take(ids.flatten())
        offsets = pc.subtract(ids.offsets, ids.offsets[0])
        return pc.binary_join(pa.ListArray.from_arrays(offsets, flat), " ")


def _plain_words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone would make some of them final
    text = text.lower()
    if _KEPT_CONTROLS.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """A minimal acyclic automaton over bytes whose words carry ids; all arrays live in one mapped file."""

    def __init__(self, keys, targets, skips, finals, starts, ids, longest: int):
        self.keys, self.targets, self.skips, self.finals = keys, targets, skips, finals
        self.starts, self.ids, self.longest = starts, ids, longest

    @staticmethod
    def compile(lexicon: dict[bytes, list[int]]) -> bytes:
        """The file of a lexicon: words enter in sorted order, and a finished suffix joins an equal one already there."""
        words = sorted(lexicon)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # open states: [final, settled transitions]; labels of the path between them
        labels: list[int] = []
        for word in words:
            same = 0
            while same < min(len(labels), len(word)) and labels[same] == word[same]:
                same += 1
            while len(labels) > same:
                child = settle(path.pop())
                path[-1][1].append((labels.pop(), child))
            for byte in word[same:]:
                labels.append(byte)
                path.append([False, []])
            path[-1][0] = True
        while labels:
            child = settle(path.pop())
            path[-1][1].append((labels.pop(), child))
        root = settle(path[0])
        counts = []
        keys, targets, skips = [], [], []
        for number, (final, moves) in enumerate(states):  # children settle before their parents
            total = int(final)
            for label, child in moves:
                keys.append(number << 8 | label)
                targets.append(child)
                skips.append(total)
                total += counts[child]
            counts.append(total)
        flat = [i for w in words for i in lexicon[w]]
        starts = np.concatenate(([0], np.cumsum([len(lexicon[w]) for w in words], dtype=np.int64)))
        arrays = [
            np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array([s[0] for s in states], np.int64),
            starts.astype(np.int64), np.array(flat, np.int64),
        ]
        head = np.array([root, max(map(len, words), default=0), *map(len, arrays)], np.int64)
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def open(cls, blob: bytes) -> Transducer:
        """Map a compiled lexicon from a file of this process that has no name and goes with it."""
        with tempfile.TemporaryFile() as file:
            file.write(blob)
            file.flush()
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        sizes, parts, at = data[2:8].tolist(), [], 8
        for n in sizes:
            parts.append(data[at : at + n])
            at += n
        found = cls(*parts, longest=int(data[1]))
        found.root = int(data[0])
        return found

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for a word that is not there; one step for all words at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        if not len(live):
            return out
        letters = np.array([words[i] for i in live], dtype=f"S{self.longest}").view(np.uint8).reshape(len(live), -1)
        sizes = sizes[live]
        state, number = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        rows = np.arange(len(live))
        for k in range(self.longest):
            ended = sizes[rows] == k
            done = rows[ended]
            good = done[self.finals[state[done]] == 1]
            out[live[good]] = number[good]
            rows = rows[~ended]
            if not len(rows):
                return out
            key = state[rows] << 8 | letters[rows, k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            rows, at = rows[there], at[there]
            state[rows] = self.targets[at]
            number[rows] += self.skips[at]
        good = rows[self.finals[state[rows]] == 1]
        out[live[good]] = number[good]
        return out

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


class Encoder:
    """Encodes blocks of texts with a transducer in front of exact merging."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer, keep: int = 600_000):
        self.vocabulary, self.transducer, self.keep = vocabulary, transducer, keep
        self.known: dict[str, bytes] = {}
        self._restart()

    def _restart(self):
        self.known = {s.upper(): np.int32(i).tobytes() for s, i in self.vocabulary.special.items()}
        self.merged: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(self.merged) + len(new) > self.keep:
            self._restart()
            new = [w for w in words if w not in self.known]
        numbers = self.transducer.find([w.encode() for w in new]).tolist()
        unseen = []
        for word, number in zip(new, numbers, strict=True):
            if number >= 0:
                self.known[word] = self.transducer.output(number).astype(np.int32).tobytes()
            else:
                unseen.append((word, self.vocabulary.pieces(word)))
        fresh = list({p for _, parts in unseen for p in parts if p not in self.merged})
        self.merged.update(zip(fresh, self.vocabulary.merge_many([p.encode() for p in fresh]), strict=True))
        for word, parts in unseen:
            self.known[word] = b"".join(map(self.merged.__getitem__, parts))

    def encode(self, texts: list[str]) -> pa.ListArray:
        split = [self.vocabulary.words(t) for t in texts]
        self._learn(set().union(*split))
        coded = [b"".join(map(self.known.__getitem__, words)) for words in split]
        offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def frequent_words(docs: DataFrame, size: int, longest: int = 64, text_col: str = "text") -> list[str]:
    """The ``size`` most frequent normalised words, of at most ``longest`` bytes, that stand in all documents more than once."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("word"))
    counted = words.where(F.octet_length("word").between(1, longest)).groupBy("word").count()
    return top_words(cut_lineage(counted.where("count > 1")), size)


def top_words(counted: DataFrame, size: int) -> list[str]:
    """The first ``size`` words of ``word, count`` by count descending, then word."""
    return [word for word, _ in top_counts(counted, size)]


def top_counts(counted: DataFrame, size: int) -> list[tuple[str, int]]:
    """The first ``size`` words of ``word, count`` by count descending, then word, with their counts, in that order.

    A histogram of the counts (at most 64 * 16 bins) gives the bins that are taken whole and the one that is split, so
    only words of that bin are sorted; the driver gets the histogram and ``size`` words, whatever the partitions.
    """
    binned = counted.select("word", "count", F.floor(16 * F.log2("count")).cast("int").alias("bin"))
    least, last, total = None, None, 0
    for r in sorted(binned.groupBy("bin").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.bin):
        if total + r.n > size:
            last = r.bin
            break
        total += r.n
        least = r.bin
    found = [] if least is None else binned.where(F.col("bin") >= least).select("word", "count").collect()
    if last is not None and total < size:
        found += binned.where(F.col("bin") == last).orderBy(F.desc("count"), "word").select("word", "count").limit(size - total).collect()
    return sorted(((r[0], r[1]) for r in found), key=lambda x: (-x[1], x[0]))


def fit_lexicon(docs: DataFrame, size: int = 50_000, vocab_path: str | None = None, longest: int = 64, text_col: str = "text") -> bytes:
    """Compile the frequent words (of at most ``longest`` bytes) of ``docs`` with their ids."""
    vocabulary = load_vocabulary(vocab_path or public_tokenizers.path("word_bpe_49k.json"))
    lexicon = {}
    for word in frequent_words(docs, size, longest, text_col):
        plain = _plain_words(word)
        if len(plain) == 1:
            raw = plain[0].encode()
            lexicon[raw] = vocabulary.encode_word(plain[0])
    return Transducer.compile(lexicon)


def _per_block(docs: DataFrame, lexicon: bytes, path: str, decoded: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        vocabulary = load_vocabulary(path)
        encoder = Encoder(vocabulary, Transducer.open(shared.value))
        for batch in slices(batches):
            ids = encoder.encode(batch.column(1).to_pylist())
            arrays = [batch.column(0), ids] + ([vocabulary.decode(ids)] if decoded else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    return docs.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def encode(docs: DataFrame, lexicon: bytes | None = None, vocab_path: str | None = None, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each text, with ``decoded`` also the text decoded from the ids."""
    path = vocab_path or public_tokenizers.path("word_bpe_49k.json")
    plain = id_and_text(docs, id_col, text_col)
    return _per_block(plain, fit_lexicon(plain, vocab_path=path) if lexicon is None else lexicon, path, decoded)


def decode(encoded: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` for a table of ``doc_id, ids``."""
    path = vocab_path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        vocabulary = load_vocabulary(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), vocabulary.decode(batch.column(1))], ["doc_id", "decoded"])

    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids")
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of an encoded and decoded table."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
