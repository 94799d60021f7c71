"""Tool calls and their results: linked, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged

CALLS = "array<struct<id:string,name:string,arguments:string,after:string>>"


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat messages ``(conv_id, turn, role, text)``.

    An assistant message that is a JSON object with ``tool_calls`` holds calls; a message of role
    ``tool`` that is an object with ``tool_call_id`` holds a result. Other messages hold neither.
    """
    calls = (
        messages.filter(F.col("role") == "assistant")
        .select("conv_id", "turn", F.explode(F.from_json(F.get_json_object("text", "$.tool_calls"), CALLS)).alias("c"))
        .select("conv_id", "turn", "c.id", "c.name", "c.arguments", "c.after")
    )
    results = messages.filter(F.col("role") == "tool").select(
        "conv_id", "turn", F.get_json_object("text", "$.tool_call_id").alias("id"),
        F.get_json_object("text", "$.content").alias("content"),
    ).filter(F.col("id").isNotNull())
    return calls, results


def reply_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as tool traffic: each user turn calls the assistant, whose next turn is the result.

    The id is ``conv_id-turn``; a call comes after the user turn two places before it.
    """
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turn, text = F.col("turn"), F.coalesce(F.col("text"), F.lit(""))
    calls = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", key(turn).alias("id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(text.alias("prompt"), F.char_length(text).cast("long").alias("length"))).alias("arguments"),
        key(turn - 2).alias("after"),
    )
    results = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", key(turn - 1).alias("id"), text.alias("content")
    )
    return calls, results


def depths(nodes: DataFrame) -> DataFrame:
    """``id, depth`` for a forest ``(id, parent)``: 0 at a root, null on or behind a cycle.

    Pointer doubling: each round a node takes over its ancestor's distance and ancestor, so a chain
    of n nodes is settled after log2(n) joins and no conversation is gathered in one task. Nodes
    still open after the number of rounds that any acyclic chain of that size needs lie on a cycle.
    """
    live = nodes.select("id", F.col("parent").alias("up"), F.lit(0).cast("long").alias("depth"))
    known = live.select(F.col("id").alias("up"))
    hop = live.join(known.withColumn("there", F.lit(True)), "up", "left").select(
        "id",
        F.when(F.col("there"), F.col("up")).alias("up"),
        F.when(F.col("there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"),
    )
    hop = staged(hop, "chat-depth")
    left = hop.filter(F.col("up").isNotNull()).count()
    rounds = max(1, left.bit_length()) if left else 0
    for _ in range(rounds):
        above = hop.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        hop = staged(
            hop.join(above, "up", "left").select(
                "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ),
            "chat-depth",
        )
        if hop.filter(F.col("up").isNotNull()).isEmpty():
            break
    return hop.select("id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _kind(value: Column) -> Column:
    """JSON type of a variant."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "integer").when(t == "BOOLEAN", "boolean")
        .when(t.startswith("DECIMAL") | (t == "DOUBLE"), "number").when(t == "VOID", "null")
        .when(t.startswith("OBJECT"), "object").otherwise("array")
    )


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``row, errors`` of the calls ``(row, name, arguments)`` that break their tool's schema.

    ``schemas`` has ``tool, field, type, required``, with types string, integer, number, boolean,
    object and array (an integer is a number). Errors, sorted: an unknown tool, arguments that are
    not a JSON object, an unknown field, a missing required field, a wrong type.
    """
    spark = calls.sparkSession
    tools = schemas.select("tool").distinct().withColumn("known", F.lit(True))
    shaped = calls.select("row", F.col("name").alias("tool"), F.try_parse_json("arguments").alias("v")).join(
        tools, "tool", "left"
    )
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    fault = F.when(F.col("known").isNull(), "unknown tool").when(~is_object, "arguments are not an object")
    faults = shaped.select("row", fault.alias("e")).filter("e IS NOT NULL")
    sound = shaped.filter(fault.isNull()).select("row", "tool", "v")
    given = sound.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
        "row", "tool", F.col("key").alias("field"), _kind(F.col("value")).alias("kind")
    )
    wanted = sound.select("row", "tool").join(schemas, "tool")
    paired = given.join(wanted, ["row", "tool", "field"], "full")
    wrong = (F.col("kind") != F.col("type")) & ~((F.col("kind") == "integer") & (F.col("type") == "number"))
    say = (
        F.when(F.col("type").isNull(), F.concat(F.lit("unknown field "), "field"))
        .when(F.col("kind").isNull() & F.col("required"), F.concat(F.lit("missing field "), "field"))
        .when(wrong, F.concat(F.lit("wrong type of "), "field"))
    )
    every = faults.unionByName(paired.select("row", say.alias("e")).filter("e IS NOT NULL"))
    return every.groupBy("row").agg(F.sort_array(F.collect_list("e")).alias("errors"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and result: ``conv_id, turn, kind, id, depth, status, errors, json``.

    ``calls`` has ``conv_id, turn, id, name, arguments, after`` (the id of the call it needs, or
    null); ``results`` has ``conv_id, turn, id, content``. Calls and results are hash-joined by
    (conversation, id). Ordering by ``conv_id, depth, turn`` is a topological order: a result comes
    after its call, and a call after the result it needs.

    Status of a call: answered, unanswered, cycle (it needs itself, perhaps through others; depth
    null), duplicate (an earlier call has its id). Status of a result: linked, orphan (no call),
    duplicate (an earlier result has its id). Of equal turns the least arguments or content come
    first. An ``after`` that names no call is ignored. Rows without conversation or id keep their
    place as duplicates or orphans of the missing id. Empty tables give no rows. ``json`` is
    canonical: keys sorted, no white space, missing values left out.
    """
    key = F.concat_ws("\u0001", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce("id", F.lit("")))
    calls = staged(calls.select("*", key.alias("key"), F.monotonically_increasing_id().alias("row")), "chat-calls")
    results = staged(results.select("*", key.alias("key"), F.monotonically_increasing_id().alias("row")), "chat-results")

    first = lambda df, tie: df.groupBy("key").agg(
        F.min(F.struct("turn", tie, "row")).alias("f")
    ).select("key", F.col("f.row").alias("first_row"), F.col("f.turn").alias("first_turn"))
    first_call, first_result = first(calls, "arguments"), first(results, "content")

    marked = calls.join(first_call.select("key", "first_row"), "key").withColumn(
        "is_first", F.col("row") == F.col("first_row")
    )
    parent = F.when(
        F.col("after").isNotNull(),
        F.concat_ws("\u0001", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "after"),
    )
    depth = staged(depths(marked.filter("is_first").select(F.col("key").alias("id"), parent.alias("parent"))), "chat-depths")
    depth = depth.withColumnRenamed("id", "key")

    answered = first_result.select("key", F.col("first_turn").alias("answer_turn"))
    errors = argument_errors(calls.select("row", "name", "arguments"), schemas)
    linked = (
        marked.hint("shuffle_hash").join(answered.withColumn("has_answer", F.lit(True)), "key", "left")
        .join(depth, "key", "left").join(errors, "row", "left")
    )
    status = (
        F.when(~F.col("is_first"), "duplicate").when(F.col("depth").isNull(), "cycle")
        .when(F.col("has_answer"), "answered").otherwise("unanswered")
    )
    arguments = F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant"))
    call_rows = linked.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "id", (2 * F.col("depth")).alias("depth"),
        status.alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        F.to_json(F.struct(
            "after", F.when(F.col("is_first"), F.col("answer_turn")).alias("answer"), arguments.alias("arguments"),
            "id", "name", F.lit("call").alias("type"),
        )).alias("json"),
    )

    known = first_call.select("key").withColumn("has_call", F.lit(True))
    back = (
        results.join(first_result.select("key", "first_row"), "key")
        .join(known, "key", "left").join(depth, "key", "left")
    )
    result_status = (
        F.when(F.col("has_call").isNull(), "orphan").when(F.col("row") != F.col("first_row"), "duplicate")
        .otherwise("linked")
    )
    result_rows = back.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "id", (2 * F.col("depth") + 1).alias("depth"),
        result_status.alias("status"), F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct("content", "id", F.lit("result").alias("type"))).alias("json"),
    )
    return call_rows.unionByName(result_rows)
