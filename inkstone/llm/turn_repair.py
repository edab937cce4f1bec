"""Conversation structure repair: a dynamic programme over the sorted turns of each conversation.

Rows are repartitioned by conversation and sorted by turn, and one pass of mapInPandas streams over them. What it carries
from row to row, and across Arrow batches, has a fixed size: for each of four states (nothing yet, after a system turn,
after a user turn, after an assistant turn) the cheapest cost, the rank of its edits in ASCII order, and a running SHA-256
of the repaired text. Ranks replace strings: the edits that lead to two states after the same rows both end with a row's
edit, so neither is a prefix of the other, and their order stays whatever follows. Which edits were taken is kept as two
bytes a row and state, and the digests of turns seen so far as 16 bytes each; both go to temporary files of the task beyond
``spill`` rows, so a conversation of any length needs memory for ``spill`` rows, its audit string aside.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn 3; a truncated turn that is
not deleted adds 3. Blank and duplicate turns are deleted. The roles' initials must become ``(s?(ua)+)?``.

Defined results: null roles and texts are one space, so a null text is blank. A null conversation identifier is a
conversation of its own. Null turns come first; rows of one turn are ordered by role, then text. Repeated rows are
duplicates. Empty texts are blank; very long ones are digested whole. Columns beside the four named ones stay behind. An
empty table gives no rows. A conversation without rows has zeros, an empty audit and the hash of the empty string.
"""

from __future__ import annotations

import hashlib
import re
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
OUTPUT = "conv_id string, none boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _expected(state: int) -> int:
    """The state that an inserted or a rerole turn leads to."""
    return ASSISTANT if state == USER else USER


#: (inserted turns, state behind them) that can come before a row or the end, from each state.
INSERTS = {q: [(0, q), (1, _expected(q))] + ([(2, ASSISTANT)] if q in (START, SYSTEM) else []) for q in range(4)}
ROLE = {USER: "user", ASSISTANT: "assistant"}
_BLANK = re.compile(r"[\x20\x09-\x0d]*\Z")


class Seen:
    """Digests of what has been seen; beyond ``spill`` of them in a temporary file."""

    def __init__(self, spill: int):
        self.spill, self.held, self.file = spill, set(), None

    def first(self, role: str, text: str) -> bool:
        """Whether this is new; it is seen from now on."""
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if digest in self.held:
            return False
        if len(self.held) < self.spill:
            self.held.add(digest)
            return True
        if self.file is None:
            self.file = sqlite3.connect("")  # a temporary file that goes with the connection
            self.file.execute("create table seen (d blob primary key) without rowid")
        return self.file.execute("insert or ignore into seen values (?)", (digest,)).rowcount == 1


class Trail:
    """The edit that led to each state after each row: two bytes a state, the last ``spill`` rows or more in memory."""

    def __init__(self, spill: int):
        self.spill, self.rows, self.held, self.file = spill, 0, bytearray(), None

    def add(self, steps: list[tuple[int, int, str] | None]) -> None:
        for step in steps:
            self.held += bytes((0, 0)) if step is None else bytes((step[0] << 2 | step[1], ord(step[2])))
        self.rows += 1
        if len(self.held) >= 8 * self.spill:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held = bytearray()

    def _backwards(self) -> Iterator[bytes]:
        yield bytes(self.held)
        if self.file is not None:
            end = self.file.tell()
            while end > 0:
                start = max(0, end - 8 * self.spill)
                self.file.seek(start)
                yield self.file.read(end - start)
                end = start

    def audit(self, state: int, inserted: int) -> str:
        """The edits that led to ``state`` after the last row, and ``inserted`` turns behind it."""
        found = ["I" * inserted]
        for block in self._backwards():
            for at in range(len(block) - 8, -1, -8):
                came, edit = block[at + 2 * state], block[at + 2 * state + 1]
                found.append("I" * (came & 3) + chr(edit))
                state = came >> 2
        return "".join(reversed(found))


class Conversation:
    """The state of one conversation, fed with its rows in order."""

    def __init__(self, spill: int):
        self.seen, self.trail = Seen(spill), Trail(spill)
        self.best = {START: (0, 0, hashlib.sha256(), False)}  # state: cost, rank, hash, whether something is hashed
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = self.initial = None
        self.turns = 0

    def fault(self, role: str, text: str) -> str | None:
        new = self.seen.first(role, text)
        if _BLANK.match(text):
            return "blank"
        if not new:
            return "duplicate"
        return None if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "truncated"

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += self.turn is None or turn != self.turn
            self.turn = self.high = turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.initial is not None:
            self.counts["illegal"] += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        found = self.fault(role, text)
        if found:
            self.counts[found] += 1
        self._step(role, initial, text, found)

    def _step(self, role: str, initial: str, text: str, found: str | None) -> None:
        chosen: dict[int, tuple] = {}
        for state, (cost, rank, *_) in self.best.items():
            for inserted, at in INSERTS[state]:
                edits = [("D", at, DELETE)]
                if found not in ("blank", "duplicate"):
                    late = TRUNCATED * (found == "truncated")
                    edits.append(("R", _expected(at), REROLE + late))
                    if initial in FOLLOWS[at]:
                        edits.append(("K", FOLLOWS[at][initial], KEEP + late))
                for edit, then, price in edits:
                    order = (cost + INSERT * inserted + price, rank, "I" * inserted + edit)
                    if then not in chosen or order < chosen[then][0]:
                        chosen[then] = (order, state, inserted, edit)
        ranks = {edits: k for k, edits in enumerate(sorted(x[0][1:] for x in chosen.values()))}
        best = {}
        for then, (order, state, inserted, edit) in chosen.items():
            turns = self._inserted(state, inserted)
            if edit != "D":
                turns.append(f"{ROLE[then] if edit == 'R' else role}:{text}")
            best[then] = (order[0], ranks[order[1:]], *self._hashed(state, turns))
        self.best = best
        self.trail.add([(chosen[q][1], chosen[q][2], chosen[q][3]) if q in chosen else None for q in range(4)])

    def _inserted(self, state: int, inserted: int) -> list[str]:
        turns = []
        for _ in range(inserted):
            state = _expected(state)
            turns.append(f"{ROLE[state]}:")
        return turns

    def _hashed(self, state: int, turns: list[str]) -> tuple:
        _, _, digest, begun = self.best[state]
        if turns:
            digest = digest.copy()
            digest.update((("\n" if begun else "") + "\n".join(turns)).encode())
        return digest, begun or bool(turns)

    def result(self) -> dict:
        ends = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        cost, _, _, state = min((cost + INSERT * ends[q], rank, "I" * ends[q], q) for q, (cost, rank, *_) in self.best.items())
        digest, _ = self._hashed(state, self._inserted(state, ends[state]))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": self.trail.audit(state, ends[state]), "repaired_sha256": digest.hexdigest()}


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: turns with the faults that the checksum of identifier and turn deals out.

    ``copies`` is 0 for a dropped row, which still names its conversation, and 2 for a repeated one.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair(turns: DataFrame, copies: Column | None = None, spill: int = 1_000_000) -> DataFrame:
    """One row for each conversation of ``turns`` (``conv_id, turn, role, text``): its faults and its cheapest repair.

    ``copies`` says how often a row counts (once, if not given).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None
        for batch in batches:
            done = []
            rows = zip(*(batch[c].tolist() for c in ("conv_id", "none", "turn", "unplaced", "role", "text", "copies")), strict=True)
            for conv_id, none, turn, unplaced, role, text, times in rows:
                if now is None or (conv_id, none) != key:
                    if now is not None:
                        done.append({"conv_id": key[0], "none": key[1], **now.result()})
                    key, now = (conv_id, none), Conversation(spill)
                for _ in range(times):
                    now.add(None if unplaced else turn, role, text)
            if done:
                yield pd.DataFrame(done)
        if now is not None:
            yield pd.DataFrame([{"conv_id": key[0], "none": key[1], **now.result()}])

    kind = turns.schema["conv_id"].dataType
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().alias("placed"), text("role").alias("role"), text("text").alias("text"), (F.lit(1) if copies is None else copies).alias("copies"),
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "conv_id", "none").sortWithinPartitions("conv_id", "none", "placed", "turn", "role", "text")
    found = dealt.withColumn("unplaced", ~F.col("placed")).drop("placed").mapInPandas(run, OUTPUT)
    return found.select(F.when(~F.col("none"), F.col("conv_id")).cast(kind).alias("conv_id"), *[c for c in found.columns if c not in ("conv_id", "none")])


# The same by comparing whole audit strings in a recursive query; a state is a struct of cost, audit and repaired text.
_STATE = "struct(cost bigint, audit varchar, words varchar)"
_NONE = f"null::{_STATE}"


def _sql_moves() -> dict[int, list[str]]:
    """Candidate structs by the state that they lead to."""
    line = lambda w, x: f"({w} || case when {w} = '' then '' else chr(10) end || {x})"
    moves: dict[int, list[str]] = {q: [] for q in range(4)}
    for state in range(4):
        for inserted, at in INSERTS[state]:
            words, seen = f"s{state}.words", state
            for _ in range(inserted):
                seen = _expected(seen)
                words = line(words, f"'{ROLE[seen]}:'")
            cost, audit = f"s{state}.cost + {INSERT * inserted}", f"s{state}.audit || '{'I' * inserted}"
            entry = lambda when, price, edit, text, s=state, c=cost, a=audit: f"case when s{s} is not null and {when} then {{'cost': {c} + {price}, 'audit': {a}{edit}', 'words': {text}}} end"
            moves[at].append(entry("true", DELETE, "D", words))
            moves[_expected(at)].append(entry("fault <> 'gone'", f"{REROLE} + late", "R", line(words, f"'{ROLE[_expected(at)]}:' || text")))
            for initial, then in FOLLOWS[at].items():
                moves[then].append(entry(f"fault <> 'gone' and role[1] = '{initial}'", "late", "K", line(words, "role || ':' || text")))
    return moves


def _crc_table() -> str:
    """The 256 steps of the CRC-32 polynomial, as a list."""
    return "(select list(b order by i) from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as b from (select unnest(range(256))::bigint as i)))"


ORACLE_SQL = f"""with recursive steps as materialized (select {_crc_table()} as t),
    named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
    kinds as (select n.*, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)), lambda crc, b: xor(crc >> 8, t[xor(crc & 255, b) + 1])), 4294967295) % 20 as kind from named n, steps),
    damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
      from kinds, range(2) as c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
    told as (select *, row_number() over (partition by conv_id, role, text order by i) as again from placed),
    judged as (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when again > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as seen,
      lag(role[1]) over (partition by conv_id order by i) || role[1] as pair from told),
    ready as (select *, case when seen in ('blank', 'duplicate') then 'gone' else seen end as fault, case when seen = 'truncated' then {TRUNCATED} else 0 end as late from judged),
    ids as (select distinct conv_id from conversations),
    walk as (
      select conv_id, 0::bigint as i, {{'cost': 0::bigint, 'audit': '', 'words': ''}}::{_STATE} as s0, {_NONE} as s1, {_NONE} as s2, {_NONE} as s3 from ids
      union all select w.conv_id, r.i, {", ".join(f"list_sort(list_filter([{', '.join(c)}], lambda x: x is not null))[1]::{_STATE}" for c in _sql_moves().values())}
      from walk w join ready r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1),
    ended as (select *, row_number() over (partition by conv_id order by i desc) as back from walk),
    best as (select conv_id, list_sort(list_filter([s0, s3, case when s2 is not null then {{'cost': s2.cost + 3, 'audit': s2.audit || 'I', 'words': s2.words || chr(10) || 'assistant:'}} end,
      case when s1 is not null then {{'cost': s1.cost + 6, 'audit': s1.audit || 'II', 'words': s1.words || chr(10) || 'user:' || chr(10) || 'assistant:'}} end], lambda x: x is not null))[1] as b from ended where back = 1),
    counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (seen = 'blank') as blank, count(*) filter (seen = 'duplicate') as duplicate,
      count(*) filter (seen = 'truncated') as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from ready group by conv_id)
    select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
      b.cost as cost, b.audit as audit, sha256(b.words) as repaired_sha256 from best b left join counts c on c.conv_id is not distinct from b.conv_id"""
