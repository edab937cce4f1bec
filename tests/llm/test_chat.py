import json
import random

import duckdb

from inkstone.llm import chat


def call(ids, after=(), arguments='{"words": 2, "text": "a b"}', name="reply"):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": arguments, "after": list(after)} for i in ids]})


def result(i, content="done"):
    return json.dumps({"tool_call_id": i, "content": content})


SCHEMA = "conv_id long, turn long, role string, text string, level int"


def test_links_levels_and_problems(spark):
    rows = [
        (1, 0, "assistant", call(["a"])), (1, 1, "tool", result("a", "é \"q\"\n")), (1, 2, "assistant", call(["b"], ["a"])),
        (1, 3, "assistant", call(["c"], ["e"])), (1, 4, "assistant", call(["d"], ["c"])), (1, 5, "assistant", call(["e"], ["b"])),
        (2, 0, "assistant", call(["x"], ["y"])), (2, 1, "assistant", call(["y"], ["x"])), (2, 2, "assistant", call(["z"], ["y"])), (2, 3, "assistant", call(["w"])),
        (3, 0, "assistant", call(["k"], arguments='{"words": "2", "text": "", "zoo": 1}')), (3, 1, "assistant", call(["l"], arguments="[1]")),
        (3, 2, "assistant", call(["m"], arguments="{bad")), (3, 3, "assistant", call(["n"], name="other")), (3, 4, "assistant", call(["o"], arguments='{"text": "' + "y" * 5000 + '"}')),
        (3, 5, "assistant", call(["k"])), (3, 6, "tool", result("zzz")), (4, 0, "assistant", None), (None, 0, "assistant", call(["q"])), (4, None, "assistant", call(["q"])),
        (4, 1, "assistant", '{"tool_calls" nonsense'), (4, 2, "user", "hello"),
    ]
    messages = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA)
    got = {(r.conv_id, r.id): r for r in chat.link(messages, chat.tool_schemas(spark)).collect()}
    assert len(got) == 15 and got[3, "zzz"].problems == "no call" and got[3, "zzz"].turn is None and not got[3, "zzz"].linked
    assert {k[1]: got[k].level for k in got if k[0] == 1} == {"a": 0, "b": 0, "e": 0, "c": 1, "d": 1}
    assert {k[1]: got[k].level for k in got if k[0] == 2} == {"x": -1, "y": -1, "z": -1, "w": 0}
    assert got[1, "a"].linked and got[1, "a"].result_turn == 1 and not got[1, "b"].linked
    assert got[1, "a"].canonical == '{"arguments":{"text":"a b","words":2},"content":"é \\"q\\"\\n","id":"a","name":"reply"}'
    assert got[3, "k"].problems == "range of text; kind of words; unknown zoo" and got[3, "k"].copies == 2
    assert got[3, "l"].problems == got[3, "m"].problems == "not an object" and got[3, "n"].problems == "unknown tool"
    assert got[3, "o"].problems == "range of text; missing words"
    assert [(r.conv_id, r.id) for r in chat.stray_results(messages).collect()] == [(3, "zzz")]
    assert {k[1]: got[k].position for k in got if k[0] == 1} == {"a": 1, "b": 2, "e": 3, "c": 4, "d": 5}
    assert {k[1]: got[k].position for k in got if k[0] == 2} == {"w": 1, "x": 2, "y": 3, "z": 4}


def slow_levels(calls):
    """Levels by repeated relaxation; calls that never settle lie in or behind a cycle."""
    level = {}
    while True:
        new = {}
        for i, (turn, after) in calls.items():
            known = [b for b in after if b in calls]
            if all(b in level for b in known):
                new[i] = max([level[b] + ((calls[b][0], b) >= (turn, i)) for b in known], default=0)
        if new.keys() == level.keys():
            return {i: level.get(i, -1) for i in calls}
        level = new


def test_levels_and_positions_equal_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(12):
        n = 40
        calls = {f"c{t}": (t, []) for t in range(n)}
        for i in calls:
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3]) if conv % 4 else 1):
                t = calls[i][0]
                other = rng.randrange(n) if conv % 3 == 0 else rng.choice([x for x in range(max(0, t - 3), min(n, t + 9)) if x != t]) if conv % 3 == 1 else min(n, t + 1)
                calls[i][1].append(f"c{other}")
        level = slow_levels(calls)
        place = {i: k for k, i in enumerate(sorted(calls, key=lambda i: (level[i] < 0, level[i], calls[i][0], i)), 1)}
        want.update({(conv, i): (level[i], place[i]) for i in calls})
        rows += [(conv, t, "assistant", call([i], after), 0) for i, (t, after) in calls.items()]
    got = chat.link(spark.createDataFrame(rows, SCHEMA).repartition(6), chat.tool_schemas(spark)).collect()
    assert {(r.conv_id, r.id): (r.level, r.position) for r in got} == want
    assert any(v[0] > 2 for v in want.values()) and any(v[0] < 0 for v in want.values())


def test_chains_take_few_rounds(spark):
    rows = [(1, f"c{t}", f"c{t + 1}", 1) for t in range(500)]
    found, rounds = chat._follow(spark.createDataFrame(rows, "conv_id long, id string, to string, step long"))
    assert rounds <= 10 and {r.id: r.step for r in found.collect()} == {f"c{t}": 500 - t for t in range(500)}


def test_conversations_as_tool_messages_equal_the_sql(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "one \"two\" \\ é\n\tthree"), (1, 3, "user", "fine 😀"), (1, 4, "assistant", ""),
            (2, 0, "assistant", "w " * 100), (2, 0, "assistant", "w " * 100), (2, 1, "user", "ok"), (3, 0, "assistant", "x" * 300_000),
            *[(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in (4, 5, 7, 8) for t in range(9) if t != 4 or c < 7], (None, 1, "assistant", "a"), (4, None, "user", "b")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link(chat.as_tool_messages(talk), chat.tool_schemas(spark))
    con = duckdb.connect()
    conversations = talk.toArrow()  # noqa: F841
    cursor = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in got.collect()), key=str) == want
    assert chat.link(chat.as_tool_messages(talk.limit(0)), chat.tool_schemas(spark)).count() == 0


def test_plan_is_native_and_hashes(spark):
    talk = spark.createDataFrame([(1, t, "assistant", "a") for t in range(0, 8, 2)] + [(1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    linked = chat.link(chat.as_tool_messages(talk), chat.tool_schemas(spark))
    linked.collect()
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Python" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
