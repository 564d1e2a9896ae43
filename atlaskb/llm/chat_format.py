"""Chat formatting with linked tool calls, in DataFrame operations only.

Every message of a conversation becomes one or more nodes. An assistant message that is a JSON object with
`tool_calls` (objects with id, name, arguments, depends_on) gives a call for each and, if it also has content, one
more node with that, which stands alone; a message of role `tool` that is
a JSON object with `tool_call_id` gives that call's result. In plain conversations the request is the call:
a user's message calls `ask` with its text as argument, and the assistant's message in the next turn is its
result; other messages stand alone.

Calls and results are hash-joined by (conversation, identifier): a call carries its result (of several, the first by turn) and
a result the turn of its call. Their order is topological: `position` is the
length of the chain of turns before a message, found by pointer jumping (each round doubles the distance, so a
conversation of any length takes a logarithmic number of rounds, and no task gathers a conversation), and
`level` the longest path of `depends_on` links before a call: calls with one dependency jump likewise to the first call
before them that has none or several, and only those with several go by rounds of relaxation. Arguments are
checked against the schema of the call's name: declared types, required properties, and no others. Each node is
serialised as canonical JSON: keys in order, no white space, at every depth.

Defined results: a null text gives a node without content or arguments' text, which fails a schema that requires
it; a null role is a message that stands alone; rows repeated for a turn give a node each and link alike; a
result without a call, or a call without a result, has linked = false and a null linked_turn; very long texts are
serialised whole; calls whose dependencies form a circle
or lead to one have a null level; dependencies on unknown identifiers are ignored; a call without a schema has valid = null; a
null conversation or turn links with nothing; empty tables give empty results; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

#: Schema of the implied call: name, property, type as schema_of_variant gives it, whether it is required.
ASK = [("ask", "text", "STRING", True)]
SCHEMA = "name string, property string, type string, required boolean"
_NODE = ["conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "content", "depends_on"]


def canonical(json: Column) -> Column:
    """A JSON text with keys in order and without white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def nodes(messages: DataFrame) -> DataFrame:
    """Calls, results and other messages of conversations (conv_id, turn, role, text)."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    json = F.when(F.col("role").isin("assistant", "tool") & F.ltrim(F.col("text")).startswith("{"), F.try_parse_json("text"))
    get = lambda path, kind: F.try_variant_get(F.col("json"), path, kind)
    rows = rows.withColumn("json", json).withColumn("calls", F.when(F.col("role") == "assistant", get("$.tool_calls", "array<variant>")))
    rows = rows.withColumn("result_of", F.when(F.col("role") == "tool", get("$.tool_call_id", "string")))
    none = F.lit(None).cast("string")
    no_deps = F.lit(None).cast("array<string>")

    of = lambda path, kind: F.try_variant_get(F.col("call"), path, kind)
    called = rows.where(F.size("calls") > 0).select("conv_id", "turn", "role", F.explode("calls").alias("call"))
    given = F.to_json(of("$.arguments", "variant"))
    as_text = of("$.arguments", "string")
    explicit = called.select(
        "conv_id", "turn", "role", F.lit("call").alias("kind"), of("$.id", "string").alias("call_id"), of("$.name", "string").alias("name"),
        F.when(F.schema_of_variant(of("$.arguments", "variant")) == "STRING", F.coalesce(canonical(as_text), given)).otherwise(given).alias("arguments"),
        none.alias("content"), of("$.depends_on", "array<string>").alias("depends_on"),
    )
    said = F.coalesce(get("$.content", "string"), F.to_json(F.when(F.schema_of_variant(get("$.content", "variant")) != "VOID", get("$.content", "variant"))))
    spoken = rows.where(F.size("calls") > 0).select("conv_id", "turn", "role", F.lit("message").alias("kind"), none.alias("call_id"), none.alias("name"), none.alias("arguments"), said.alias("content"), no_deps.alias("depends_on"))
    turn_id = lambda t: F.concat(F.lit("turn:"), t.cast("string"))
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    single = rows.where(F.coalesce(F.size("calls"), F.lit(0)) <= 0).select(
        "conv_id", "turn", "role",
        F.when(asks, "call").when(answers | F.col("result_of").isNotNull(), "result").otherwise("message").alias("kind"),
        F.when(asks, turn_id(F.col("turn"))).when(answers, turn_id(F.col("turn") - 1)).otherwise(F.col("result_of")).alias("call_id"),
        F.when(asks, F.lit("ask")).alias("name"),
        F.when(asks, F.to_json(F.struct("text"))).alias("arguments"),
        F.when(F.col("result_of").isNotNull(), F.coalesce(get("$.content", "string"), F.to_json(get("$.content", "variant")))).when(~F.coalesce(asks, F.lit(False)), F.col("text")).alias("content"),
        no_deps.alias("depends_on"),
    )
    return explicit.select(_NODE).unionByName(spoken.where("content <> ''").select(_NODE)).unionByName(single.select(_NODE))


def positions(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, position): how many turns lie before each one in its unbroken chain of turns."""
    known = turns.select("conv_id", "turn").where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    known = scratch.put(known, "turns")
    before = known.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has"))
    table = known.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("has"), F.col("turn") - 1).alias("up"), F.when(F.col("has"), 1).otherwise(0).cast("long").alias("position"))
    table = scratch.put(table, "positions")
    ended, open_ = table.where("up IS NULL"), table.where("up IS NOT NULL")
    while not open_.isEmpty():
        # Only turns that haven't met the head of their chain look further up.
        above = ended.unionByName(open_).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("position").alias("more"))
        moved = open_.join(above, ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up"), (F.col("position") + F.col("more")).alias("position"))
        moved = scratch.put(moved, "positions")
        ended, open_ = ended.unionByName(moved.where("up IS NULL")), moved.where("up IS NOT NULL")
    return ended.drop("up")


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) of calls with depends_on; null where dependencies form a circle or lead to one."""
    key = ["conv_id", "call_id"]
    links = calls.select(*key, F.explode("depends_on").alias("dep"))
    links = scratch.put(links.join(calls.select("conv_id", F.col("call_id").alias("dep")).distinct(), ["conv_id", "dep"], "left_semi").distinct(), "links")
    every = calls.select(*key).where("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    if links.isEmpty():
        return every.withColumn("level", F.lit(0).cast("long"))
    needs = links.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep"))
    one = F.col("n") == 1
    table = every.join(needs, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"), F.when(one, F.col("dep")).otherwise(F.col("call_id")).alias("anchor"), F.when(one, 1).otherwise(0).cast("long").alias("far"))
    table = scratch.put(table, "calls")
    ended, open_ = table.where("n <> 1").drop("n"), table.where("n = 1").drop("n")
    # Each round doubles how far calls have jumped: beyond a conversation's calls, what is still open goes in a circle.
    most, jumped = table.groupBy("conv_id").count().agg(F.max("count")).first()[0], 1
    while jumped <= 2 * most and not open_.isEmpty():
        above = ended.withColumn("done", F.lit(True)).unionByName(open_.withColumn("done", F.lit(False)))
        above = above.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("far").alias("more"), "done")
        moved = open_.join(above, ["conv_id", "anchor"]).select(*key, F.col("next").alias("anchor"), (F.col("far") + F.col("more")).alias("far"), "done")
        moved = scratch.put(moved, "jumps")
        ended, open_ = ended.unionByName(moved.where("done").drop("done")), moved.where("NOT done").drop("done")
        jumped *= 2
    ended = scratch.put(ended, "anchors")
    joints = table.where("n > 1").select(*key)
    # Links of calls with several dependencies, to the anchors of those; none for one that ends in a circle.
    steps = links.join(joints, key, "left_semi").join(ended.withColumnsRenamed({"call_id": "dep"}), ["conv_id", "dep"], "left")
    steps = scratch.put(steps.select(*key, "anchor", (F.col("far") + 1).alias("far")), "steps")
    level = scratch.put(table.where("n = 0").select(*key, F.lit(0).cast("long").alias("level")), "levels")
    waiting = scratch.put(joints, "waiting")
    while not waiting.isEmpty():
        ready = steps.join(waiting, key, "left_semi").join(level.withColumnsRenamed({"call_id": "anchor", "level": "below"}), ["conv_id", "anchor"], "left")
        ready = ready.groupBy(*key).agg(F.max(F.col("below") + F.col("far")).alias("level"), F.max(F.col("below").isNull()).alias("open"))
        ready = scratch.put(ready.where(~F.col("open")).select(*key, "level"), "ready")
        if ready.isEmpty():
            break
        level = scratch.put(level.unionByName(ready), "levels")
        waiting = scratch.put(waiting.join(ready, key, "left_anti"), "waiting")
    found = ended.join(level.withColumnsRenamed({"call_id": "anchor"}), ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return every.join(found, key, "left")


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `valid`: whether the arguments fit the schema of the name, null without one."""
    rules = schemas.groupBy("name").agg(F.collect_list(F.struct("property", "type", "required")).alias("rules"))
    given = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>")
    kind = lambda rule: F.schema_of_variant(F.try_element_at(F.col("given"), rule["property"]))
    fits = F.forall("rules", lambda r: F.when(F.map_contains_key("given", r["property"]), kind(r) == r["type"]).otherwise(~r["required"]))
    closed = F.size(F.array_except(F.map_keys("given"), F.transform("rules", lambda r: r["property"]))) == 0
    checked = calls.join(rules, "name", "left").withColumn("given", given)
    return checked.withColumn("valid", F.when(F.col("rules").isNotNull(), F.coalesce(fits & closed, F.lit(False)))).drop("rules", "given")


def linked(found: DataFrame) -> DataFrame:
    """Nodes with the turn of what they link to and, for calls, the result."""
    key = ["conv_id", "call_id"]
    keyed = found.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    calls, results = F.col("kind") == "call", F.col("kind") == "result"
    answers = keyed.where(results).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("to"))
    asks = keyed.where(calls).groupBy(*key).agg(F.struct(F.min("turn").alias("turn"), F.lit(None).cast("string").alias("content")).alias("to"))
    whole = found.where(calls).join(answers.hint("shuffle_hash"), key, "left").unionByName(found.where(results).join(asks.hint("shuffle_hash"), key, "left"))
    alone = found.where(~calls & ~results).withColumn("to", F.lit(None).cast(answers.schema["to"].dataType))
    return whole.unionByName(alone).withColumns({"linked": F.col("to").isNotNull(), "linked_turn": F.col("to.turn"), "result": F.col("to.content")}).drop("to")


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per node: conv_id, turn, position, level, kind, call_id, linked, linked_turn, valid, json."""
    scratch = Scratch(messages.sparkSession, "chat")
    found = scratch.put(nodes(messages), "nodes")
    place = positions(found, scratch)
    level = levels(found.where("kind = 'call'"), scratch)
    joined = linked(found).join(place, ["conv_id", "turn"], "left").join(level, ["conv_id", "call_id"], "left")
    checked = validated(joined, schemas)
    out = F.struct(
        F.try_parse_json("arguments").alias("arguments"),
        F.when(F.col("kind") != "message", F.col("call_id")).alias("call_id"),
        "content",
        "name",
        "result",
        "role",
        "turn",
    )
    call = F.col("kind") == "call"
    return scratch.end(checked.select(
        "conv_id", "turn", "position", F.when(call, F.col("level")).otherwise(F.lit(0)).cast("long").alias("level"), "kind", "call_id",
        "linked", "linked_turn", F.when(call, F.col("valid")).alias("valid"), F.to_json(out).alias("json"),
    ))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"), spark.createDataFrame(ASK, SCHEMA))


SQL = r"""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
island AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn - rn ORDER BY turn) - 1 AS position
  FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM (SELECT DISTINCT conv_id, turn FROM m))),
n AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'turn:' || turn WHEN 'assistant' THEN 'turn:' || (turn - 1) END AS call_id
  FROM m)
SELECT n.conv_id, n.turn, position, 0::BIGINT AS level, kind, call_id,
       CASE kind WHEN 'call' THEN EXISTS (SELECT 1 FROM m r WHERE r.conv_id = n.conv_id AND r.turn = n.turn + 1 AND r.role = 'assistant')
                 WHEN 'result' THEN EXISTS (SELECT 1 FROM m r WHERE r.conv_id = n.conv_id AND r.turn = n.turn - 1 AND r.role = 'user')
                 ELSE false END AS linked,
       CASE kind WHEN 'call' THEN (SELECT min(r.turn) FROM m r WHERE r.conv_id = n.conv_id AND r.turn = n.turn + 1 AND r.role = 'assistant')
                 WHEN 'result' THEN (SELECT min(r.turn) FROM m r WHERE r.conv_id = n.conv_id AND r.turn = n.turn - 1 AND r.role = 'user') END AS linked_turn,
       CASE WHEN kind = 'call' THEN text IS NOT NULL END AS valid,
       CASE WHEN kind = 'call' AND answer IS NOT NULL THEN json_object('arguments', json_object('text', text), 'call_id', call_id, 'name', 'ask', 'result', answer, 'role', role, 'turn', n.turn)::VARCHAR
            ELSE CASE kind WHEN 'call' THEN json_object('arguments', json_object('text', text), 'call_id', call_id, 'name', 'ask', 'role', role, 'turn', n.turn)
                 WHEN 'result' THEN json_object('call_id', call_id, 'content', text, 'role', role, 'turn', n.turn)
                 ELSE json_object('content', text, 'role', role, 'turn', n.turn) END::VARCHAR END AS json
FROM n JOIN island USING (conv_id, turn)
LEFT JOIN (SELECT conv_id, turn - 1 AS turn, min(text) AS answer FROM m WHERE role = 'assistant' GROUP BY ALL) a USING (conv_id, turn)
"""
