"""Chat formatting: tool-call linking, with DataFrame functions only.

Calls and results are joined by identifier, calls are put in topological order over the calls they depend on,
arguments are checked against the schema of their tool, and each linked call is serialised as canonical JSON (keys
sorted at every level, no white space).

The level of a call is the number of calls before it on its chain of parents. Levels come from pointer doubling:
each round joins every call with the ancestor it points to and doubles the distance, so n calls need about log2(n)
joins by identifier, and no conversation is ever gathered in one task.

An identifier counts within its conversation. `link` gives one row a call or orphan result; `link_all` gives every row
of its input, so that nothing goes without a trace.

Cases: a call or result without an identifier is `no_id` and is linked with nothing (`link` leaves such results out). Of
several calls or results with one identifier in a conversation the first (by turn, then text) counts; the others are
`duplicate` (`link` leaves them out). Rows that are neither calls nor results are `other_role`. A result without a call is
`orphan`, a call without a result `unanswered`. A parent that doesn't exist in the conversation is as none. Calls on a
cycle, or behind one, are `cyclic` and have no level. Arguments that are null or no JSON object are invalid, and are null
in the JSON. Tools without a schema are invalid by name. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import materialize


@dataclass(frozen=True)
class Field:
    """A property of a tool's arguments. kind: string, integer, number, boolean, array or object."""

    kind: str
    required: bool = True
    least_length: int | None = None
    most_length: int | None = None


#: What schema_of_variant says of each kind.
_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def _errors_of(tool: str, fields: Mapping[str, Field], arguments: Column, text: Column) -> Column:
    """An array with a message for each thing wrong with the arguments, in the order of the names."""
    found = []
    for name in sorted(fields):
        f = fields[name]
        value = F.try_variant_get(arguments, f"$['{name}']", "variant")
        kind = F.schema_of_variant(value)
        right = F.lit(False)
        for k in _KINDS[f.kind]:
            right = right | kind.startswith(k)
        missing = value.isNull()
        check = F.when(missing, F.lit(f"{name}: missing") if f.required else F.lit(None)).when(~right, F.lit(f"{name}: not {f.kind}"))
        length = F.length(F.try_variant_get(arguments, f"$['{name}']", "string"))
        if f.least_length is not None:
            check = check.when(length < f.least_length, F.lit(f"{name}: too short"))
        if f.most_length is not None:
            check = check.when(length > f.most_length, F.lit(f"{name}: too long"))
        found.append(check)
    other = F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in sorted(fields)]))
    found.append(F.when(F.size(other) > 0, F.concat(F.lit("unknown: "), F.array_join(F.sort_array(other), ","))))
    return F.array_compact(F.array(*found))


def validated(calls: DataFrame, schemas: Mapping[str, Mapping[str, Field]], name: str = "name", arguments: str = "arguments") -> DataFrame:
    """calls with `parsed` (variant; null unless a JSON object) and `errors` (array of strings; empty if valid)."""
    parsed = F.try_parse_json(F.col(arguments))
    parsed = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    errors = F.array(F.lit("no schema"))
    for tool in sorted(schemas):
        errors = F.when(F.col(name) == tool, _errors_of(tool, schemas[tool], F.col("parsed"), F.col(arguments))).otherwise(errors)
    with_parsed = calls.withColumn("parsed", parsed)
    return with_parsed.withColumn("errors", F.when(F.col("parsed").isNull(), F.array(F.lit("no object"))).otherwise(errors))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) for calls (call_id, parent_id) with distinct identifiers; level is null on and behind cycles."""
    known = calls.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    state = calls.select("call_id", "parent_id").join(known, "parent_id", "left").select("call_id", F.when(F.col("there"), F.col("parent_id")).alias("up"))
    state = materialize(state.select("call_id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("level")), "tool-levels")
    n = state.count()
    for _ in range(n.bit_length() + 1):
        if state.filter("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = state.filter("up IS NOT NULL").join(above, "up").select("call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        state = materialize(state.filter("up IS NULL").unionByName(moved), "tool-levels")
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


_CALL, _RESULT = ["turn", "parent_id", "name", "arguments"], ["turn", "content"]


def _key(identifier: str) -> Column:
    return F.struct("conv_id", F.col(identifier).alias("id"))


def _first(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row an identifier of a conversation: the smallest by the other columns."""
    return rows.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct(*columns)).alias("r")).select("conv_id", "call_id", "r.*")


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `row`, a number of each; exact copies are told apart by it."""
    return materialize(rows.select("conv_id", "call_id", *columns, F.monotonically_increasing_id().alias("row")), "tool-rows")


def _counted(own: DataFrame, answers: DataFrame) -> DataFrame:
    """First calls and first results side by side, with levels and statuses."""
    own = own.withColumn("key", _key("call_id"))
    parents = own.select(F.col("key").alias("call_id"), F.when(F.col("parent_id").isNotNull(), _key("parent_id")).alias("parent_id"))
    placed = own.join(levels(parents).withColumnRenamed("call_id", "key"), "key").withColumn("is_call", F.lit(True))
    answers = answers.select(_key("call_id").alias("key"), F.col("turn").alias("r_turn"), "content", F.lit(True).alias("is_result"))
    joined = placed.select("key", "turn", "name", "arguments", "level", "is_call").join(answers, "key", "full")
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.col("level").isNull(), "cyclic").when(F.col("is_result").isNull(), "unanswered").otherwise("linked")
    turn = F.when(F.col("is_call").isNotNull(), F.col("turn")).otherwise(F.col("r_turn"))
    return joined.select(F.col("key.conv_id").alias("conv_id"), turn.alias("turn"), F.col("key.id").alias("call_id"), "name", "arguments", "content", "level", "is_call", status.alias("status"))


def _marked_calls(calls: DataFrame) -> DataFrame:
    """Calls that are linked with nothing, as no_id or duplicate."""
    unnamed = F.col("call_id").isNull()
    return calls.select("conv_id", "turn", "call_id", "name", "arguments", F.when(unnamed, 0).cast("long").alias("level"), F.lit(True).alias("is_call"), F.when(unnamed, "no_id").otherwise("duplicate").alias("status"))


def _described(rows: DataFrame, schemas: Mapping[str, Mapping[str, Field]]) -> DataFrame:
    is_call = F.col("is_call").isNotNull()
    body = F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    return validated(rows, schemas).select(
        "conv_id",
        "turn",
        "call_id",
        "status",
        "level",
        F.when(is_call, F.size("errors") == 0).otherwise(False).alias("valid"),
        F.when(is_call, F.array_join("errors", "; ")).otherwise("no call").alias("errors"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("json"),
    )


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Field]]) -> DataFrame:
    """calls: conv_id, turn, call_id, parent_id, name, arguments; results: conv_id, turn, call_id, content.

    One row a call or orphan result: conv_id, turn, call_id, status (linked, unanswered, orphan, cyclic, no_id), level, valid,
    errors, json. Ordered by (conv_id, level, turn, call_id) calls come after those that they depend on. Duplicates and results
    without an identifier have no row here; see link_all.
    """
    joined = _counted(_first(calls, _CALL), _first(results, _RESULT))
    return _described(joined.unionByName(_marked_calls(calls.filter("call_id IS NULL")), allowMissingColumns=True), schemas)


def link_all(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Field]], others: DataFrame | None = None) -> DataFrame:
    """As link, with every other row too: repeated calls and results as `duplicate`, results without an identifier as `no_id`,
    and others (conv_id, turn, content), which are neither calls nor results, as `other_role`.

    The result of a linked or cyclic call is in the call's row; every other row of the input has a row of its own. Duplicates are
    told by row numbers, so that an identifier of many rows isn't gathered in one task.
    """
    calls, results = _numbered(calls, _CALL), _numbered(results, _RESULT)
    own, answers = _first(calls, [*_CALL, "row"]), _first(results, [*_RESULT, "row"])
    rows = _counted(own, answers).unionByName(_marked_calls(calls.join(own.select("row"), "row", "left_anti")), allowMissingColumns=True)
    again = results.join(answers.select("row"), "row", "left_anti").select("conv_id", "turn", "call_id", "content", F.when(F.col("call_id").isNull(), "no_id").otherwise("duplicate").alias("status"))
    rows = rows.unionByName(again, allowMissingColumns=True)
    if others is not None:
        rows = rows.unionByName(others.select("conv_id", "turn", "content", F.lit("other_role").alias("status")), allowMissingColumns=True)
    return _described(rows, schemas)


#: Tool of the conversations table: a user's turn asks, the next turn of the assistant answers.
TURN_SCHEMAS = {"answer": {"query": Field("string", least_length=1, most_length=400), "turn": Field("integer")}}


def calls_of_turns(turns: DataFrame) -> DataFrame:
    """User turns as calls of `answer`; each depends on the user turn two before it."""
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), "turn"))
    return turns.filter("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("parent_id"), F.lit("answer").alias("name"), arguments.alias("arguments"))


def results_of_turns(turns: DataFrame) -> DataFrame:
    name = F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    return turns.filter("role = 'assistant'").select("conv_id", "turn", name.alias("call_id"), F.col("text").alias("content"))


def others_of_turns(turns: DataFrame) -> DataFrame:
    return turns.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", F.col("text").alias("content"))
