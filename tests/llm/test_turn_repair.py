import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from inkstone.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The repaired conversation, by trying every script up to two insertions at each place."""

    def initials_of(roles):
        return "".join(r[:1] for r in roles)

    found, seen, faults = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0d]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if re.search(r"[.!?][\x20\x09-\x0d]*\Z", text) else "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        found.append(fault)
    best = None
    gap = ["", "I", "II"]
    per_row = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    for edits in itertools.product(*per_row):
        for inserts in itertools.product(gap, repeat=len(rows) + 1):
            for first in itertools.product("ua", repeat=sum(map(len, inserts))):
                given, cost, audit, out = iter(first), 0, "", []
                for k in range(len(rows) + 1):
                    for _ in inserts[k]:
                        out.append(({"u": "user", "a": "assistant"}[next(given)], ""))
                        cost, audit = cost + 3, audit + "I"
                    if k < len(rows):
                        edit, (role, text) = edits[k], rows[k]
                        audit += edit[0]
                        if edit == "D":
                            cost += 4
                            continue
                        cost += 3 * (edit != "K") + 3 * (found[k] == "truncated")
                        out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[edit[1]], text))
                if re.fullmatch("(s?(ua)+)?", initials_of(r for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return {**faults, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": best[0], "audit": best[1], "repaired_sha256": hashlib.sha256(best[2].encode()).hexdigest()}


def test_brute_force(spark):
    rng = random.Random(5)
    texts, roles = ["Yes.", "No", " ", "Why?", "Done. "], ["user", "assistant", "system", "tool", "user"]
    talks = {c: [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, 4))] for c in range(60)}
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    rng.shuffle(rows)
    found = {r.conv_id: r.asDict() for r in turn_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for c, talk in talks.items():
        want = brute([(r, t) for _, r, t in talk])
        assert {k: found[c][k] for k in want} == want, talk
        assert found[c]["gaps"] == 0


def test_spilled_rows_give_the_same(spark):
    rng = random.Random(6)
    texts = ["Yes.", "No", "", "Why?"] + [f"Text {k}." for k in range(50)]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "other"]), rng.choice(texts)) for c in range(3) for t in range(700)]
    table = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(df.collect())
    assert key(turn_repair.repair(table, spill=7)) == key(turn_repair.repair(table))


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    done = turn_repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(done) == len(rows)
    for r in done:
        name = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        kind = zlib.crc32(name.encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(kind, 1)
        if r.conv_id is not None:
            assert r.text == {0: "", 1: "", 2: "One Two"}.get(kind, "One. Two!")
            assert r.role == ("user" if kind == 4 else "assistant")


def test_edge_cases(spark):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [
        (None, 1, "user", "Hm."), (None, 1, "user", "Hm."), (1, None, None, None), (2, 9, "user", "a." * 300_000), (2, 5, "system", "Be."), (2, 5, "system", "Be."), (2, None, "user", "Early."),
    ]
    extra = T.StructType(list(spark.createDataFrame(rows, SCHEMA).schema) + [T.StructField("cost", T.StringType()), T.StructField("none", T.StringType())])
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], extra)
    found = {r.conv_id: r for r in turn_repair.repair(table).collect()}
    assert set(found) == {None, 1, 2}
    assert (found[None].duplicate, found[None].audit, found[None].cost) == (1, "KDI", 7)
    assert (found[1].blank, found[1].audit, found[1].repaired_sha256, found[1].gaps) == (1, "D", empty, 0)
    assert (found[2].gaps, found[2].duplicate) == (3, 1)
    gone = turn_repair.repair(spark.createDataFrame(rows[3:4], SCHEMA), turn_repair.F.lit(0)).collect()[0]
    assert (gone.gaps, gone.cost, gone.audit, gone.repaired_sha256) == (0, 0, "", empty)
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rows", [6000])
def test_one_conversation_over_many_batches(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        table = spark.range(rows).selectExpr("7L as conv_id", "id as turn", "case when id % 2 = 0 then 'user' else 'assistant' end as role", "concat('Text ', id, '.') as text")
        found = turn_repair.repair(table, spill=500).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.audit, r.cost, r.gaps) for r in found] == [("K" * rows, 0, 0)]
