"""Packing: fixed-width training sequences by order-preserving dynamic programming.

A partition's documents, in the order of their ids, form one stream of tokens (each document ends with id 0).
Candidate cuts are the ends of documents, the ends of sentences, and, inside a sentence of more than
``long_sentence`` tokens, every ``stride`` tokens. The programme chooses cuts at most ``window`` tokens apart that
minimise

    sum of (window - length)  +  the penalty of each cut: 0 after a document, ``sentence_penalty`` after a sentence,
    ``inner_penalty`` elsewhere.

With f(i) = best(i) + position(i), best(k) = penalty(k) + window - position(k) + min f(i) over the candidates i
within one window before k; a monotone queue holds that minimum, so a stream of n candidates takes O(n) steps.

The programme runs over the whole stream. Every ``block`` tokens it gives out the cuts that all candidates still in the
queue have in common, since every later choice leads back to one of those; what follows is kept. So the cuts do not
depend on ``block``, and memory holds about a block, or the longest stretch without an end of a sentence: chains meet at
such ends within a few windows.

Scale: there is no shuffle. Each task sorts and packs its own partition. Only the last sequence of a partition is short.
A sequence's id is the partition's number times 2**32 plus a running number; a retried task sees the same rows in the
same order and so gives the same ids.

Defined results: a null or empty text gives one piece of one token (the id 0). Rows with the same doc_id are packed as
documents of their own, in the order of their texts' hashes. Of equally good cuts the earlier candidate is taken. A
window narrower than ``long_sentence`` cuts longer sentences every ``stride`` tokens, at most a window. An empty table
gives no rows. Extra columns are left behind. A null doc_id stays null.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import id_and_text, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
END_ID = 0


@lru_cache(maxsize=2)
def load_encoder(ranks_path: str):
    """The byte-level vocabulary: (encoder, per id whether the token ends a sentence)."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    ends = np.zeros(max(ranks.values()) + 2, dtype=bool)
    for token, rank in ranks.items():
        ends[rank] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in token
    special = {"<|endoftext|>": len(ranks)}
    encoder = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return encoder, ends


def encode(encoder, text: str) -> np.ndarray:
    """Ids of a text with the closing id 0; the vocabulary's special string in a text is its special id."""
    return np.append(encoder.encode_to_numpy(text, allowed_special="all"), np.uint32(END_ID)).astype(np.uint32)


class Cuts:
    """The dynamic programme over a stream of candidates; neighbours lie within a window of each other."""

    def __init__(self, window: int):
        self.window = window
        self.first = 0  # number of the first candidate that is kept: the last cut given out
        self.places, self.best, self.back = [0], [0.0], [-1]
        self.queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f, place, number; f rises

    def add(self, places: list[int], penalties: list[float]) -> None:
        queue, window, number = self.queue, self.window, self.first + len(self.places)
        for here, penalty in zip(places, penalties, strict=True):
            while queue[0][1] < here - window:
                queue.popleft()
            low, _, i = queue[0]
            f = penalty + window + low
            self.places.append(here)
            self.best.append(f - here)
            self.back.append(i)
            while queue and queue[-1][0] >= f:
                queue.pop()
            queue.append((f, here, number))
            number += 1

    def _chain(self, number: int, stop: int) -> list[int]:
        """Places of the cuts after candidate ``stop`` up to candidate ``number``."""
        found = []
        while number > stop:
            found.append(self.places[number - self.first])
            number = self.back[number - self.first]
        return found[::-1]

    def settled(self) -> list[int]:
        """Cuts that no later candidate can change; they are given out once."""
        live = {number for _, _, number in self.queue}
        while len(live) > 1:  # the latest goes back one cut until all have met
            latest = max(live)
            live.discard(latest)
            live.add(self.back[latest - self.first])
        return self._give(live.pop())

    def finish(self) -> list[int]:
        """All remaining cuts; the last candidate is the stream's end."""
        return self._give(self.first + len(self.places) - 1)

    def _give(self, number: int) -> list[int]:
        found = self._chain(number, self.first)
        drop = number - self.first
        if drop:
            del self.places[:drop], self.best[:drop], self.back[:drop]
            self.first = number
        return found


class Packer:
    """Packs one ordered stream of documents, a block of tokens at a time."""

    def __init__(self, sentence_ends: np.ndarray, window=1024, block=1 << 17, sentence_penalty=8.0, inner_penalty=24.0, long_sentence=48, stride=16):
        self.ends, self.window, self.block = sentence_ends, window, block
        self.sentence_penalty, self.inner_penalty = sentence_penalty, inner_penalty
        self.long_sentence, self.stride = min(long_sentence, window), max(1, min(stride, window))
        self.pending: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start in the document, ids, document's length
        self.low = 0  # place of the first pending token, which is the last cut given out
        self.seen = 0  # candidates are known up to this place
        self.mark = 0  # the last end of a sentence or document
        self.end = 0  # place after the last pending token
        self.cuts = Cuts(window)
        self.sequences = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):  # a document longer than a block enters in parts
            part = ids[at : at + self.block]
            self.pending.append((doc_id, at, part, len(ids)))
            self.end += len(part)
            at += len(part)
            if self.end - self.seen >= self.block:
                self._learn()
                yield from self._emit(self.cuts.settled())

    def finish(self) -> Iterator[tuple]:
        if self.end > self.low:
            self._learn()
            yield from self._emit(self.cuts.finish())

    def _learn(self) -> None:
        """Give the candidates of the tokens that came since to the programme."""
        places, doc_ends, at = [], [], self.end
        for _, start, part, total in reversed(self.pending):
            low = max(self.seen, at - len(part))
            places.append(np.flatnonzero(self.ends[part[len(part) - (at - low) :]]) + low + 1)
            if start + len(part) == total:
                doc_ends.append(at)
            at -= len(part)
            if at <= self.seen:
                break
        doc_ends = np.array(doc_ends[::-1], np.int64)
        sentences = np.concatenate(places[::-1])
        marks = np.union1d(sentences, doc_ends)
        gaps = np.concatenate(([self.mark], marks, [self.end]))
        inner = []
        for g in np.flatnonzero(np.diff(gaps) > self.long_sentence).tolist():
            # In the last, still open gap a place at the very end is a candidate too: a token that ended a sentence would be a mark.
            inner.append(np.arange(gaps[g] + self.stride, gaps[g + 1] + (g == len(gaps) - 2), self.stride))
        inner = np.concatenate(inner) if inner else np.zeros(0, np.int64)
        inner = np.setdiff1d(inner[inner > self.cuts.places[-1]], marks)
        found = np.union1d(marks, inner)
        penalty = np.full(len(found), self.sentence_penalty)
        penalty[np.searchsorted(found, inner)] = self.inner_penalty
        penalty[np.searchsorted(found, doc_ends)] = 0.0
        self.cuts.add(found.tolist(), penalty.tolist())
        self.seen = self.end
        if len(marks):
            self.mark = int(marks[-1])

    def _emit(self, given: list[int]) -> Iterator[tuple]:
        if not given:
            return
        cuts = np.array([self.low, *given], np.int64)
        stop, at, rest = int(cuts[-1]), self.low, []
        piece: list | None = None  # doc_id, start, ids in parts, document's length, sequence, offset
        for doc_id, start, part, total in self.pending:
            low, high = at, at + len(part)
            at = high
            if low >= stop:
                rest.append((doc_id, start, part, total))
                continue
            a, k = low, int(np.searchsorted(cuts, low, "right")) - 1
            while a < min(high, stop):
                b = min(high, int(cuts[k + 1]))
                if piece is None:
                    piece = [doc_id, start + a - low, [], total, self.sequences + k, a - int(cuts[k])]
                piece[2].append(part[a - low : b - low])
                if b == cuts[k + 1] or start + b - low == total:
                    ids = np.concatenate(piece[2])
                    yield doc_id, piece[1], len(ids), ids.tobytes(), total, piece[4], piece[5]
                    piece = None
                k += b == cuts[k + 1]
                a = b
            if high > stop:
                rest.append((doc_id, start + stop - low, part[stop - low :], total))
        self.sequences += len(cuts) - 1
        self.pending, self.low = rest, stop


def pack(docs: DataFrame, ranks_path: str | None = None, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pieces of the packed documents: ``doc_id, start, length, ids`` (little-endian 32-bit), ``doc_tokens, sequence_id, offset``."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        encoder, ends = load_encoder(path)
        packer = Packer(ends, window=window, **options)
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def out(rows):
            columns = list(zip(*rows, strict=True))
            columns[5] = [base + s for s in columns[5]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in packer.add(doc_id, encode(encoder, text)):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield out(rows)
                        rows = []
        for row in packer.finish():
            rows.append(row)
        if rows:
            yield out(rows)

    ordered = id_and_text(docs, id_col, text_col).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return ordered.mapInArrow(run, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
