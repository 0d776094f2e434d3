"""Linking of tool calls and results in chats, with DataFrame functions only.

Calls and results meet in a hash join on conversation and identifier. Calls are ordered by their
dependencies (a call comes after every call that it names), arguments are checked against schemas, and
every message becomes one line of canonical JSON: keys sorted, no white space, values unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import forget, new_path, written

#: Schema of one tool: argument name to (type, required). Types: string, integer, number, boolean, array, object.
ToolSchemas = dict[str, dict[str, tuple[str, bool]]]

_TYPE_PATTERNS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def _argument_errors(name: Column, arguments: Column, schemas: ToolSchemas) -> Column:
    """Sorted array of what is wrong with a call's arguments; empty if valid."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    unreadable = value.isNull() | ~kind.startswith("OBJECT")
    cases = F.when(unreadable, F.array(F.lit("arguments are not a JSON object")))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, (want, required) in sorted(fields.items()):
            own = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            missing = own.isNull() | (own == "VOID")
            if required:
                checks.append(F.when(missing, F.lit(f"{field} is missing")))
            checks.append(F.when(~missing & ~own.rlike(_TYPE_PATTERNS[want]), F.lit(f"{field} is not {want}")))
        allowed = F.array(*(F.lit(f) for f in sorted(fields))) if fields else F.array().cast("array<string>")
        extra = F.transform(F.array_except(F.json_object_keys(arguments), allowed), lambda x: F.concat(x, F.lit(" is unknown")))
        found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        cases = cases.when(name == tool, F.array_sort(F.concat(found, F.coalesce(extra, F.array().cast("array<string>")))))
    return cases.otherwise(F.array(F.lit("tool is unknown")))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level): the number of calls on the longest chain before a call; null on a cycle.

    Kahn's rounds: the edges from calls that got a level leave, and calls that have no edge left then get the next one.
    A round per level; names of absent calls do not count. Rounds read the edges still there, not the levels given.
    """
    spark, ids = calls.sparkSession, ["conv", "call_id"]
    nodes = calls.select(*ids).distinct()
    edges = calls.select(*ids, F.explode("after").alias("before")).distinct()
    waiting = written(edges.join(nodes.withColumnRenamed("call_id", "before"), ["conv", "before"], "left_semi"), "edges")
    ready, level, path = written(nodes.join(waiting, ids, "left_anti"), "ready"), 0, new_path(spark, "levels")
    while True:
        ready.withColumn("level", F.lit(level)).write.mode("append").parquet(path)
        if ready.isEmpty() or waiting.isEmpty():
            break
        gone = ready.withColumnRenamed("call_id", "before")
        rest = written(waiting.join(gone, ["conv", "before"], "left_anti"), "waiting")
        freed = waiting.join(gone, ["conv", "before"], "left_semi").select(*ids).distinct()
        fresh = written(freed.join(rest, ids, "left_anti"), "ready")
        forget(waiting, ready)
        waiting, ready, level = rest, fresh, level + 1
    return nodes.join(spark.read.schema(f"conv {calls.schema['conv'].dataType.simpleString()}, call_id string, level int").parquet(path), ids, "left")


def link_tool_calls(messages: DataFrame, schemas: ToolSchemas) -> DataFrame:
    """One row per call and per result, linked, ordered, checked and serialised.

    messages: conv, turn, kind ('call' or 'result'), call_id, tool, arguments (JSON text), after (ids of
    calls that must come before) and content (text of a result). Other columns are not looked at.

    Returns conv, turn, kind, call_id, tool, level (topological: a result's is its call's; null for a call on
    a cycle and for a result without a call), linked (calls: has a result; results: has a call), valid and
    errors (of a call's arguments; a result has its call's), and json.

    Rows without conv, turn, kind or call_id are left out, as are other kinds. Of calls with one id in a
    conversation the first by turn counts and the others get the error "identifier is taken"; ties fall to
    the smaller arguments. Repeated results are all kept. Equal ids in different conversations are apart.
    An empty table gives no rows. Texts are taken whole.
    """
    known = messages.where("conv IS NOT NULL AND turn IS NOT NULL AND call_id IS NOT NULL AND kind IN ('call', 'result')")
    known = known.select("conv", "turn", "kind", "call_id", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"), "content")
    calls, results = known.where("kind = 'call'"), known.where("kind = 'result'")
    order = F.struct("turn", F.coalesce("arguments", F.lit("")), F.coalesce("tool", F.lit("")))
    first = calls.groupBy("conv", "call_id").agg(F.min_by(F.struct("turn", "tool", "arguments", "after"), order).alias("x"), F.count("*").alias("copies"))
    first = first.select("conv", "call_id", "x.*", "copies")
    errors = _argument_errors(F.col("tool"), F.col("arguments"), schemas)
    checked = written(first.withColumn("errors", errors), "calls")
    levels = written(_levels(checked), "call_levels")
    ids = ["conv", "call_id"]
    answered = results.groupBy(*ids).agg(F.count("*").alias("answers"))
    whole = checked.join(levels.hint("shuffle_hash"), ids).join(answered.hint("shuffle_hash"), ids, "left")
    heads = whole.select(
        "conv", "turn", F.lit("call").alias("kind"), "call_id", "tool", "level", F.col("answers").isNotNull().alias("linked"), "errors", "arguments", "after", F.lit(None).cast("string").alias("content")
    )
    # later calls under a taken identifier, counted by their columns so that no identifier's rows meet in one place
    same = [*ids, "turn", "tool", "arguments", "after"]
    variants = written(calls.groupBy(*same).agg(F.count("*").alias("n")), "call_variants")
    firsts = checked.where("copies > 1").select(*ids, F.struct("turn", "tool", "arguments", "after").alias("x"))
    taken = variants.join(firsts, ids).withColumn("n", F.col("n") - F.struct("turn", "tool", "arguments", "after").eqNullSafe(F.col("x")).cast("int")).where("n > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select(
        "conv", "turn", F.lit("call").alias("kind"), "call_id", "tool", F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.array(F.lit("identifier is taken")).alias("errors"), "arguments", "after", F.lit(None).cast("string").alias("content")
    )
    owners = checked.select(*ids, F.col("tool").alias("own_tool"), F.col("errors").alias("own_errors")).join(levels, ids)
    owners = written(owners, "owners")
    tails = results.join(owners.hint("shuffle_hash"), ids, "left").select(
        "conv", "turn", "kind", "call_id", F.coalesce("own_tool", "tool").alias("tool"), "level", F.col("own_errors").isNotNull().alias("linked"),
        F.coalesce("own_errors", F.array(F.lit("call is unknown"))).alias("errors"), F.lit(None).cast("string").alias("arguments"), F.array().cast("array<string>").alias("after"), "content",
    )
    every = heads.unionByName(taken).unionByName(tails)
    return every.select("conv", "turn", "kind", "call_id", "tool", "level", "linked", (F.size("errors") == 0).alias("valid"), "errors", _canonical().alias("json"))


def _canonical() -> Column:
    """Canonical JSON of a row; a variant keeps the keys of its objects sorted."""
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    call = F.concat(F.lit('{"after":'), F.to_json(F.array_sort("after")), F.lit(',"arguments":'), arguments, F.lit(',"id":'), text("call_id"), F.lit(',"tool":'), text("tool"), F.lit(',"type":"call"}'))
    result = F.concat(F.lit('{"content":'), text("content"), F.lit(',"id":'), text("call_id"), F.lit(',"tool":'), text("tool"), F.lit(',"type":"result"}'))
    return F.when(F.col("kind") == "call", call).otherwise(result)


def calls_from_turns(conversations: DataFrame, chain: int = 4) -> DataFrame:
    """Plain chats as tool messages: each user turn asks the tool `reply`, and the assistant's next turn is its result.

    A system turn asks `configure`. A call names the call two turns before it, unless a new chain begins
    (every `chain` pairs). Rows with a null conversation, turn or role are left out.
    """
    known = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    turn, role = F.col("turn"), F.col("role")
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    arguments = F.concat(F.lit('{ "turn": '), turn.cast("string"), F.lit(', "text" : '), quoted, F.lit(', "final": '), (turn % (2 * chain) == 0).cast("string"), F.lit("}"))
    return known.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.when(role == "assistant", "result").otherwise("call").alias("kind"),
        F.when(role == "assistant", name(turn - 1)).otherwise(name(turn)).alias("call_id"),
        F.when(role == "user", "reply").when(role == "system", "configure").alias("tool"),
        F.when(role != "assistant", arguments).alias("arguments"),
        F.when((role == "user") & (turn % (2 * chain) > 1), F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
        F.when(role == "assistant", F.col("text")).alias("content"),
    )


#: Schemas of the tools that calls_from_turns uses.
TURN_TOOLS: ToolSchemas = {
    "configure": {"turn": ("integer", True), "text": ("string", True), "final": ("boolean", False)},
    "reply": {"turn": ("integer", True), "text": ("string", True), "final": ("boolean", True)},
}
