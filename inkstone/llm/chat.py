"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Messages have ``conv_id, turn, role, text``. An assistant message with calls is a JSON object
``{"tool_calls": [{"id", "name", "arguments" (JSON text), "after": [ids]}]}``; a tool message with a result is
``{"tool_call_id", "content"}``. Other texts hold no calls.

Linking is a shuffled hash join of calls and results on (conversation, identifier), so a conversation with very many turns
spreads over all tasks. The topological order is (level, turn, id): a call's level is the greatest number of forward
references, that is of ``after`` identifiers that belong to a later turn, on a path that leads to it. ``position`` is the
call's place in that order in its conversation. Calls that wait for one other call are chains, which pointer doubling
follows in a logarithmic number of rounds; calls that wait for several are settled once all those are, in as many rounds
as such calls stand behind each other. Calls in or behind a cycle get level -1 and come last.

Arguments are checked against a table of tool schemas (``name, key, kind, required, low, high``), which is a small
dimension of this module's caller. Canonical JSON has keys in order and no spaces.

Only DataFrame functions are used.

Defined results: messages with a null conv_id, turn or text, or texts that are no such JSON, hold no calls. Of calls, or
of results, that repeat an identifier within a conversation the first by turn, then by content, counts, and
``copies`` tells how many there were. A result without a call is a row of its own in ``link``: not linked, without level,
turn and position, its problem "no call". Identifiers in ``after`` that no call of the conversation has do not count.
Arguments that are no JSON object are the problem "not an object". Extra columns are not carried; empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.runtime import cut_lineage

CALL = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
# How a JSON type is named by schema_of_variant.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
REPLY = [("reply", "text", "string", True, 1, 4000), ("reply", "words", "integer", True, 1, 60), ("reply", "turn", "integer", False, 0, None)]


def tool_schemas(spark: SparkSession, rows: list[tuple] = REPLY) -> DataFrame:
    """Schemas of tools: one row per argument; bounds are of a number's value or a string's length."""
    return spark.createDataFrame(rows, "name string, key string, kind string, required boolean, low long, high long")


def parse_calls(messages: DataFrame) -> DataFrame:
    """``conv_id, id, turn, name, arguments, after, copies`` of each call."""
    found = messages.where((F.col("role") == "assistant") & F.col("text").contains('"tool_calls"'))
    calls = found.select("conv_id", "turn", F.explode(F.from_json("text", CALL)["tool_calls"]).alias("c")).select("conv_id", "turn", "c.*")
    calls = calls.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("id").isNotNull())
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("c")
    return calls.groupBy("conv_id", "id").agg(first, F.count("*").alias("copies")).select("conv_id", "id", "c.*", "copies")


def parse_results(messages: DataFrame) -> DataFrame:
    """``conv_id, id, result_turn, content`` of each result."""
    found = messages.where((F.col("role") == "tool") & F.col("text").contains('"tool_call_id"'))
    results = found.select("conv_id", "turn", F.from_json("text", RESULT).alias("r")).select("conv_id", "turn", "r.*")
    results = results.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("tool_call_id").isNotNull())
    return results.groupBy("conv_id", F.col("tool_call_id").alias("id")).agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r")).select("conv_id", "id", "r.*")


def levels(calls: DataFrame) -> DataFrame | None:
    """``conv_id, id, level`` of calls above level 0 (-1: in or behind a cycle); None if no reference points forward."""
    key = ["conv_id", "id"]
    turns = calls.select("conv_id", F.col("id").alias("before"), F.col("turn").alias("before_turn"))
    links = calls.select("conv_id", "id", "turn", F.explode("after").alias("before")).distinct().join(turns, ["conv_id", "before"])
    forward = (F.col("before_turn") > F.col("turn")) | ((F.col("before_turn") == F.col("turn")) & (F.col("before") >= F.col("id")))
    links = cut_lineage(links.select("conv_id", "id", "before", forward.cast("long").alias("step")))
    if links.where("step = 1").isEmpty():
        return None
    degree = links.groupBy(*key).agg(F.count("*").alias("degree"))
    chains, _ = _follow(links.join(degree.where("degree = 1"), key).select(*key, F.col("before").alias("to"), "step"))
    several = degree.where("degree > 1").select(*key)
    # Links of calls that wait for several, past the chains they lead into; a chain that ends in a cycle never settles.
    through = chains.select("conv_id", F.col("id").alias("before"), F.col("to").alias("past"), F.col("step").alias("more"), "cyclic")
    onward = links.join(several, key, "left_semi").join(through, ["conv_id", "before"], "left")
    onward = onward.select(*key, F.coalesce("past", "before").alias("to"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    onward = cut_lineage(onward.join(several.withColumnRenamed("id", "to").withColumn("waits", F.lit(True)), ["conv_id", "to"], "left"))
    settled, known = None, -1
    while True:
        level, is_open = F.lit(0), F.col("waits").isNotNull()
        rows = onward
        if settled is not None:
            rows = onward.join(settled.withColumnsRenamed({"id": "to", "level": "known"}), ["conv_id", "to"], "left")
            level, is_open = F.coalesce("known", F.lit(0)), is_open & F.col("known").isNull()
        rows = rows.groupBy(*key).agg(F.max(is_open | F.col("cyclic")).alias("open"), F.max(F.col("step") + level).alias("level"))
        settled = cut_lineage(rows.where("not open").select(*key, "level"))
        before, known = known, settled.count()
        if known == before:
            break
    stuck = several.join(settled, key, "left_anti").select(*key, F.lit(-1).cast("long").alias("level"))
    found = settled.unionByName(stuck)
    at_end = chains.join(found.withColumnsRenamed({"id": "to", "level": "known"}), ["conv_id", "to"], "left")
    of_chain = F.when(F.col("cyclic") | (F.col("known") < 0), -1).otherwise(F.col("step") + F.coalesce("known", F.lit(0)))
    return found.unionByName(at_end.select(*key, of_chain.alias("level"))).where("level <> 0").select(*key, F.col("level").cast("int").alias("level"))


def _follow(single: DataFrame) -> tuple[DataFrame, int]:
    """(``conv_id, id, to, step, cyclic``: where each chain of single links ends and how many steps forward that is; rounds)."""
    now = cut_lineage(single)
    rounds = max(1, now.count()).bit_length() + 1  # a chain that goes on after so many doublings is a cycle
    for k in range(rounds):
        on = now.select("conv_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("step").alias("more"))
        both = now.join(on, ["conv_id", "to"], "left")
        now = cut_lineage(both.select("conv_id", "id", F.coalesce("next", "to").alias("to"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.col("next").isNotNull().alias("cyclic")))
        if now.where("cyclic").isEmpty():
            break
    return now, k + 1


def with_positions(rows: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """``rows`` with ``position``: the place (from 1) in the order of a conversation.

    Rows are dealt by ranges of the whole order, so a very long conversation lies in many parts; each part's share of a
    conversation is counted, and the counts of earlier parts are added."""
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    dealt = cut_lineage(dealt).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    shares = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    shares = shares.select("conv_id", "part", "first", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    return dealt.join(shares, ["conv_id", "part"]).select(*names, (F.col("at") - F.col("first") + F.col("earlier") + 1).alias("position"))


def argument_problems(value: Column, schema: Column) -> Column:
    """Problems of parsed arguments against an array of schema rows, in the order of their keys."""
    given = F.try_variant_get(value, "$", "map<string,variant>")

    def one(rule: Column) -> Column:
        v = F.element_at(given, rule["key"])
        kind = F.schema_of_variant(v)
        fits = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), rule["kind"]) == kind, F.lit(False))
        size = F.when(rule["kind"] == "string", F.length(F.try_variant_get(v, "$", "string"))).when(rule["kind"] == "integer", F.try_variant_get(v, "$", "bigint"))
        return (
            F.when(v.isNull(), F.when(rule["required"], F.concat(F.lit("missing "), rule["key"])))
            .when(~fits, F.concat(F.lit("kind of "), rule["key"]))
            .when((size < rule["low"]) | (size > rule["high"]), F.concat(F.lit("range of "), rule["key"]))
        )

    extra = F.array_sort(F.array_except(F.map_keys(given), F.transform(schema, lambda r: r["key"])))
    told = F.concat(F.filter(F.transform(schema, one), lambda x: x.isNotNull()), F.transform(extra, lambda k: F.concat(F.lit("unknown "), k)))
    return F.when(schema.isNull(), F.array(F.lit("unknown tool"))).when(given.isNull(), F.array(F.lit("not an object"))).otherwise(told)


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: its place in the order, its result, its problems, and the pair as canonical JSON; and one per
    result without a call."""
    calls = cut_lineage(parse_calls(messages))
    tools = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "required", "low", "high"))).alias("schema"))
    found = levels(calls)
    ordered = calls.select("conv_id", "id", "turn", F.lit(0).alias("level"))
    if found is not None:
        ordered = ordered.drop("level").join(found.hint("shuffle_hash"), ["conv_id", "id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    ordered = with_positions(ordered, [(F.col("level") < 0).alias("late"), F.col("level"), F.col("turn"), F.col("id")], ["conv_id", "id", "level"])
    rows = calls.join(ordered.hint("shuffle_hash"), ["conv_id", "id"])
    rows = rows.join(parse_results(messages).hint("shuffle_hash"), ["conv_id", "id"], "full").join(tools, "name", "left")
    rows = rows.withColumn("value", F.try_parse_json("arguments"))
    called = F.col("turn").isNotNull()
    problems = F.when(called, F.array_join(argument_problems(F.col("value"), F.col("schema")), "; ")).otherwise("no call")
    # to_json writes the fields in this order, which is the order of their names; a variant's keys are in order already.
    record = F.struct(
        F.coalesce("value", F.try_parse_json(F.lit("null"))).alias("arguments"), F.col("content"), F.col("id"), F.col("name")
    )
    linked = called & F.col("result_turn").isNotNull()
    return rows.select(
        "conv_id", "id", "level", "position", "turn", "result_turn", linked.alias("linked"), "copies",
        problems.alias("problems"), F.to_json(record).alias("canonical"),
    )


def stray_results(messages: DataFrame) -> DataFrame:
    """Results whose identifier no call of the conversation has."""
    return parse_results(messages).join(parse_calls(messages).select("conv_id", "id"), ["conv_id", "id"], "left_anti")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool messages: each assistant turn calls ``reply`` and the user turn after it is the result.

    In conversations whose number leaves 0 by 3 a call waits for the assistant's call before it, with 1 for the one after it
    (turns stand against the order), with 2 for both, which makes cycles. All is found from a row's own turn, so no window
    is needed."""
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, kind = F.col("turn"), F.pmod("conv_id", F.lit(3))
    words = F.size(F.array_remove(F.split("text", "[ \t-\r]+"), ""))
    arguments = F.to_json(F.struct(words.alias("words"), "text", "turn"))
    after = F.when(kind == 0, F.array(name(turn - 2))).when(kind == 1, F.array(name(turn + 2))).otherwise(F.array(name(turn - 2), name(turn + 2)))
    call = F.struct(F.array(F.struct(name(turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls"))
    result = F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content"))
    told = F.when(F.col("role") == "assistant", F.to_json(call)).when(F.col("role") == "user", F.to_json(result)).otherwise(F.col("text"))
    role = F.when(F.col("role") == "user", F.lit("tool")).otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), told.alias("text"))


ORACLE_SQL = r"""
with calls as (
  select conv_id, turn, count(*) as copies, min(text) as text
  from conversations where role = 'assistant' and text is not null and conv_id is not null and turn is not null group by conv_id, turn
), results as (
  select conv_id, turn, min(text) as content from conversations
  where role = 'user' and text is not null and conv_id is not null and turn is not null group by conv_id, turn
), runs as (
  select conv_id, turn, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as run from calls
), levels as (
  select conv_id, turn, case ((conv_id % 3) + 3) % 3 when 0 then 0
      when 1 then count(*) over (partition by conv_id, turn % 2, run order by turn desc) - 1
      else case when count(*) over (partition by conv_id, turn % 2, run) > 1 then -1 else 0 end end as level
  from runs
), rows as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, 'call-' || coalesce(c.conv_id, r.conv_id) || '-' || coalesce(c.turn, r.turn - 1) as id,
         c.turn, c.copies, c.text, r.turn as result_turn, r.content,
         len(list_filter(string_split_regex(c.text, '[ \t-\r]+'), lambda x: x <> '')) as words
  from calls c full join results r on r.conv_id = c.conv_id and r.turn = c.turn + 1
)
select conv_id, id, level::int as level,
       case when turn is not null then row_number() over (partition by conv_id, turn is null order by level < 0, level, turn, id) end as position,
       turn, result_turn, turn is not null and result_turn is not null as linked, copies,
       case when turn is null then 'no call' else
         concat_ws('; ', case when length(text) not between 1 and 4000 then 'range of text' end,
                         case when turn < 0 then 'range of turn' end, case when words not between 1 and 60 then 'range of words' end) end as problems,
       '{"arguments":' || case when turn is null then 'null' else '{"text":' || to_json(text)::varchar || ',"turn":' || turn || ',"words":' || words || '}' end
         || coalesce(',"content":' || to_json(content)::varchar, '') || ',"id":"' || id || '"' || case when turn is null then '}' else ',"name":"reply"}' end as canonical
from rows left join levels using (conv_id, turn)
"""
