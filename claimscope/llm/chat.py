"""Chat formatting: link tool calls with their results, order them, validate, serialise.

Messages carry tool calls and results as JSON: a call message holds
``{"tool_call": {"id", "name", "arguments": {...}, "after": id or null}}``, a result message
``{"tool_result": {"id", "content"}}``.  Calls meet results in a hash join by conversation and
identifier.  A call may wait for one other call (``after``); its level is the length of that
chain, found by pointer doubling (rounds grow with the logarithm of the longest chain), and
(level, turn, call_id) is a topological order.  Arguments are validated against a schema per
tool, and each call with its result is serialised as canonical JSON: keys sorted, no blanks.
Only DataFrame functions are used.

Skew: nothing is collected per conversation, so a conversation may hold any share of all rows;
the joins read written tables, whose hot partitions can be split.

Edge cases, by status: ``ok``; ``invalid`` (see errors: unknown_tool, bad_arguments,
missing:<field>, type:<field>, extra:<field>); ``no_result``; ``no_dependency`` (waits for an
unknown call; level null); ``cycle`` (level null); ``repeated_id`` (all but the first call of an
identifier); ``orphan_result`` (a result without a call).  Of several results the first counts.
Null and empty texts and texts that aren't such JSON are no tool messages.  Empty tables give
empty results; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import table, written

_MESSAGE = "tool_call struct<id:string,name:string,arguments:string,after:string>, tool_result struct<id:string,content:string>"


@dataclass(frozen=True)
class Field:
    """``kind``: string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True


Schemas = dict[str, tuple[Field, ...]]

#: The tools of the registered query.
SCHEMAS: Schemas = {
    "lookup": (Field("key", "string"), Field("strict", "boolean", False)),
    "note": (Field("body", "string"), Field("size", "integer")),
    "search": (Field("limit", "integer"), Field("query", "string")),
}

_KINDS = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY.*$",
    "object": r"^OBJECT.*$",
}


def json_text(value: Column) -> Column:
    """A JSON string literal of a text."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def tool_messages(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(calls, results) among the messages."""
    parsed = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.from_json(F.col(text_col).cast("string"), _MESSAGE).alias("m")
    )
    calls = parsed.filter((F.col("role") == "assistant") & F.col("m.tool_call.id").isNotNull()).select("conv_id", "turn", F.col("m.tool_call.id").alias("call_id"), "m.tool_call.name", "m.tool_call.arguments", "m.tool_call.after")
    results = parsed.filter((F.col("role") == "tool") & F.col("m.tool_result.id").isNotNull()).select("conv_id", "turn", F.col("m.tool_result.id").alias("call_id"), "m.tool_result.content")
    return calls, results


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): level 0 waits for nothing, else one more than the awaited call.
    Null where the awaited call is unknown or the chain is a cycle; ``fate`` tells which."""
    known = calls.select("conv_id", "call_id", F.col("after").alias("up"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.lit(False).alias("lost"))
    state = written(known, "call-chains")
    total, rounds = state.count(), 0
    while True:
        up = state.select(F.col("conv_id").alias("u_conv"), F.col("call_id").alias("u_id"), F.col("up").alias("u_up"), F.col("steps").alias("u_steps"), F.col("lost").alias("u_lost"))
        open_ = state.filter(F.col("up").isNotNull())
        stepped = open_.join(up, (F.col("conv_id").eqNullSafe(F.col("u_conv"))) & (F.col("up") == F.col("u_id")), "left").select(
            "conv_id", "call_id", F.col("u_up").alias("up"), (F.col("steps") + F.coalesce("u_steps", F.lit(0).cast("bigint"))).alias("steps"),
            (F.col("u_id").isNull() | F.coalesce("u_lost", F.lit(False))).alias("lost"),
        )
        state = written(state.filter(F.col("up").isNull()).unionByName(stepped), "call-chains")
        rounds += 1
        left = state.filter(F.col("up").isNotNull()).limit(1).count()
        if not left or (1 << rounds) > max(2, 2 * total):  # what is still open after that many steps turns in a cycle
            break
    fate = F.when(F.col("up").isNotNull(), "cycle").when(F.col("lost"), "no_dependency")
    return state.select("conv_id", "call_id", F.when(fate.isNull(), F.col("steps")).alias("level"), fate.alias("fate"))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call's arguments."""
    value = F.try_parse_json(arguments)
    whole = F.schema_of_variant(value)
    keys = F.json_object_keys(arguments)
    none = F.array().cast("array<string>")
    by_tool = None
    for tool, fields in sorted(schemas.items()):
        checks = []
        for f in fields:
            kind = F.schema_of_variant(F.try_variant_get(value, f"$.{f.name}", "variant"))
            absent = ~F.array_contains(keys, f.name)
            checks.append(F.when(absent, F.lit(f"missing:{f.name}") if f.required else F.lit(None)).when(~kind.rlike(_KINDS[f.kind]), F.lit(f"type:{f.name}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(f.name) for f in fields])), lambda k: F.concat(F.lit("extra:"), k))
        found = F.array_sort(F.concat(F.array_compact(F.array(*checks)), extra))
        by_tool = F.when(name == tool, found) if by_tool is None else by_tool.when(name == tool, found)
    bad = arguments.isNull() | value.isNull() | ~F.coalesce(whole.rlike("^OBJECT"), F.lit(False))
    listed = F.array(*[F.lit(t) for t in schemas])
    known = by_tool.otherwise(none) if by_tool is not None else none
    return F.when(name.isNull() | ~F.array_contains(listed, name), F.array(F.lit("unknown_tool"))).when(bad, F.array(F.lit("bad_arguments"))).otherwise(known)


def link_tool_calls(messages: DataFrame, schemas: Schemas, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per call (and per result without a call): conv_id, call_id, turn, name, level, status, errors,
    result_turn, n_results, canonical."""
    calls, results = tool_messages(messages, conv_col, turn_col, role_col, text_col)
    # the first call of an identifier stands; a hot conversation has many identifiers, an identifier few calls
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "arguments", "after"))
    calls = written(calls.withColumn("nth", nth), "calls")
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    first = written(first.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("r.turn").alias("result_turn"), "r.content", "n_results"), "results")
    ranks = levels(calls.filter(F.col("nth") == 1)).select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_id"), "level", "fate")
    joined = calls.join(first, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left")
    joined = written(joined, "linked-calls").join(ranks, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("call_id") == F.col("l_id")) & (F.col("nth") == 1), "left")
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    status = (
        F.when(F.col("nth") > 1, "repeated_id").when(F.col("fate").isNotNull(), F.col("fate")).when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "no_result").otherwise("ok")
    )
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    canonical = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"name":'), F.coalesce(json_text(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.when(F.col("n_results").isNull() | F.col("content").isNull(), "null").otherwise(json_text(F.col("content"))), F.lit("}"),
    )
    linked = joined.withColumn("errors", errors).select(
        "conv_id", "call_id", "turn", "name", "level", status.alias("status"), F.array_join("errors", ",").alias("errors"), "result_turn",
        F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"), canonical.alias("canonical"),
    )
    ids = calls.select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"))
    orphans = first.join(ids, F.col("r_conv").eqNullSafe(F.col("c_conv")) & (F.col("r_id") == F.col("c_id")), "left_anti").select(
        F.col("r_conv").alias("conv_id"), F.col("r_id").alias("call_id"), F.lit(None).cast(calls.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("bigint").alias("level"), F.lit("orphan_result").alias("status"), F.lit("").alias("errors"), "result_turn", "n_results",
        F.concat(F.lit('{"id":'), json_text(F.col("r_id")), F.lit(',"result":'), F.when(F.col("content").isNull(), "null").otherwise(json_text(F.col("content"))), F.lit("}")).alias("canonical"),
    )
    return linked.unionByName(orphans)


def derived_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as tool messages: a user turn becomes a call that waits for the call of half
    its turn (if that isn't itself), any other turn the result of the call one turn before."""
    ident = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    turn, size = F.col("turn"), F.length("text")
    name = F.element_at(F.array(F.lit("lookup"), F.lit("note"), F.lit("search"), F.lit("guess")), (F.pmod(size, F.lit(4)) + 1).cast("int"))
    quoted = json_text(F.col("text"))
    arguments = (
        F.when(name == "lookup", F.concat(F.lit('{"strict": true, "key": '), quoted, F.lit("}")))
        .when(name == "note", F.concat(F.lit('{"size": '), F.when(F.pmod(size, F.lit(3)) == 0, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string")), F.lit(', "body": '), quoted, F.lit("}")))
        .when(name == "search", F.concat(F.lit('{"query": '), quoted, F.when(F.pmod(size, F.lit(5)) == 0, F.lit(', "page": 1}')).otherwise(F.concat(F.lit(', "limit": '), size.cast("string"), F.lit("}")))))
        .otherwise(F.lit("{}"))
    )
    half = F.floor(turn / 2)
    after = F.when(half < turn, F.concat(F.lit('"'), ident(half), F.lit('"'))).otherwise("null")
    call = F.concat(F.lit('{"tool_call": {"id": "'), ident(turn), F.lit('", "name": "'), name, F.lit('", "arguments": '), arguments, F.lit(', "after": '), after, F.lit("}}"))
    result = F.concat(F.lit('{"tool_result": {"id": "'), ident(turn - 1), F.lit('", "content": '), quoted, F.lit("}}"))
    user = F.col("role") == "user"
    return conversations.filter(F.col("text").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", F.when(user, "assistant").otherwise("tool").alias("role"), F.when(user, call).otherwise(result).alias("text")
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(derived_messages(table(spark, sf_dir, "conversations")), SCHEMAS)


SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role = 'user' AS u, text, length(text) AS n FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL),
calls0 AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, CASE n % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'note' WHEN 2 THEN 'search' ELSE 'guess' END AS name,
    CASE WHEN turn // 2 < turn THEN 'c' || (turn // 2) END AS after, to_json(text)::VARCHAR AS quoted, n FROM m WHERE u),
calls AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, quoted) AS nth,
    CASE name WHEN 'lookup' THEN '{"key":' || quoted || ',"strict":true}'
      WHEN 'note' THEN '{"body":' || quoted || ',"size":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || '}'
      WHEN 'search' THEN CASE WHEN n % 5 = 0 THEN '{"page":1,"query":' || quoted || '}' ELSE '{"limit":' || n || ',"query":' || quoted || '}' END
      ELSE '{}' END AS arguments,
    CASE WHEN name = 'note' AND n % 3 = 0 THEN 'type:size' WHEN name = 'search' AND n % 5 = 0 THEN 'extra:page,missing:limit'
      WHEN name = 'guess' THEN 'unknown_tool' ELSE '' END AS errors
  FROM calls0),
up(conv_id, call_id, cur, steps) AS (
  SELECT conv_id, call_id, after, 0::BIGINT FROM calls WHERE nth = 1
  UNION ALL
  SELECT up.conv_id, up.call_id, c.after, steps + 1 FROM up JOIN calls c ON c.nth = 1 AND c.conv_id = up.conv_id AND c.call_id = up.cur),
levels AS (SELECT conv_id, call_id, arg_max(cur IS NULL, steps) AS whole, max(steps) AS steps FROM up GROUP BY ALL),
results AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS result_turn, count(*) AS n_results, min_by(to_json(text)::VARCHAR, turn) AS content
  FROM m WHERE NOT u GROUP BY ALL)
SELECT c.conv_id, c.call_id, c.turn, c.name, CASE WHEN c.nth = 1 AND whole THEN l.steps END AS level,
  CASE WHEN c.nth > 1 THEN 'repeated_id' WHEN NOT whole THEN 'no_dependency' WHEN c.errors <> '' THEN 'invalid'
    WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
  c.errors, r.result_turn, coalesce(r.n_results, 0) AS n_results,
  '{"arguments":' || c.arguments || ',"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(r.content, 'null') || '}' AS canonical
FROM calls c JOIN levels l USING (conv_id, call_id) LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, NULL, 'orphan_result', '', r.result_turn, r.n_results, '{"id":"' || r.call_id || '","result":' || r.content || '}'
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
