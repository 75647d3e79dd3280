"""Tool calls of conversations: linked to their results, ordered, validated and serialised, with DataFrame functions only.

A message is a row: conv_id, turn, role, text; a call also has call_id, tool, arguments (JSON) and after (the call whose
result it uses, or null), a result has result_for.  Calls meet results in a hash join by conversation and identifier.  A call's
level is its distance from calls that use none, found by pointer doubling, so a chain of n calls takes log2(n) joins; calls
on a cycle have none.  Nothing is gathered by conversation, so a conversation may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import left_join, written

#: Arguments of the tools: (tool, argument, JSON type, required, least number).
SCHEMAS = (
    ("search", "query", "STRING", True, None), ("search", "limit", "BIGINT", True, 0),
    ("lookup", "id", "BIGINT", True, 1), ("lookup", "strict", "BOOLEAN", False, None),
    ("compute", "op", "STRING", True, None), ("compute", "values", "ARRAY", True, None),
)
_KEY = ["conv_id", "call_id"]


def calls(messages: DataFrame) -> DataFrame:
    """One row per call: the message of least turn that bears its identifier, then of least text."""
    fields = F.struct("turn", "text", "role", "tool", "arguments", "after")
    first = messages.where(F.col("call_id").isNotNull()).groupBy(*_KEY).agg(F.min(fields).alias("m"), F.count("*").alias("n_calls"))
    return first.select(*_KEY, "m.*", "n_calls")


def levels(all_calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, dangling: null level on a cycle; a call whose ``after`` names no call has level 0 and dangles."""
    # identifiers alone are doubled; texts stay where they are
    known = all_calls.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("known"))
    now = left_join(all_calls.select("conv_id", "call_id", F.col("after").alias("parent")), known, ["conv_id", "parent"])
    dangling = F.col("parent").isNotNull() & F.col("known").isNull()
    now = written(now.select("conv_id", "call_id", F.when(F.col("known"), F.col("parent")).alias("parent"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"), dangling.alias("dangling")))
    n = now.where(F.col("parent").isNotNull()).count()
    reach = 1
    while n and reach <= n:
        up = now.select("conv_id", F.col("call_id").alias("parent"), F.col("parent").alias("next"), F.col("steps").alias("more"))
        now = written(left_join(now, up, ["conv_id", "parent"]).select(
            "conv_id", "call_id", F.col("next").alias("parent"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "dangling"
        ))
        reach *= 2
        if not now.where(F.col("parent").isNotNull()).head(1):
            break
    return now.select("conv_id", "call_id", F.when(F.col("parent").isNull(), F.col("steps")).alias("level"), "dangling")


def _typed(value: Column, kind: str) -> Column:
    """Whether the JSON value is of the type; no value is of any."""
    found = F.schema_of_variant(value)
    return found.startswith("ARRAY") if kind == "ARRAY" else found == kind


def problems(tool: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """What is wrong with a call's arguments, in the order of the schema: an array of short texts."""
    parsed = F.try_parse_json(arguments)
    rules = [F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")]
    fine = rules[0].isNull()
    rules.append(F.when(fine & (tool.isNull() | ~tool.isin(sorted({s[0] for s in schemas}))), "unknown tool"))
    for name, argument, kind, required, least in schemas:
        value = F.try_variant_get(parsed, f"$.{argument}", "variant")
        mine = fine & (tool == name)
        if required:
            rules.append(F.when(mine & value.isNull(), f"{argument} is missing"))
        rules.append(F.when(mine & value.isNotNull() & ~_typed(value, kind), f"{argument} is not {kind.lower()}"))
        if least is not None:
            number = F.try_variant_get(parsed, f"$.{argument}", "bigint")
            rules.append(F.when(mine & _typed(value, kind) & (number < least), f"{argument} is below {least}"))
    return F.array_compact(F.array(*rules))


def quoted(value: Column) -> Column:
    """A JSON string, or null."""
    return F.coalesce(F.substring(F.to_json(F.array(value)), 2, 2147483647).substr(F.lit(1), F.length(F.to_json(F.array(value))) - 2), F.lit("null"))


def canonical(arguments: Column) -> Column:
    """JSON with its keys sorted and no blanks; malformed text as a JSON string."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), quoted(arguments))


def linked(messages: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per message: conv_id, turn, role, kind, call_id, status, level, errors, message.

    kind: call, result or text.  status of a call: answered, unanswered or repeated (a later message with its identifier);
    of a result: linked, or orphan if no call bears the identifier.  A result takes its call's level, so ordering a
    conversation by level, kind and turn puts every call before its result and after those it uses; a text has none.
    errors: of the arguments, then "dangling" or "cycle".  message: the row as canonical JSON.  Null identifiers link
    nothing; repeated results all link; an empty table gives no rows.
    """
    own = messages.select("conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "after", "result_for")
    held = written(calls(own))
    placed = levels(held)
    answered = own.where(F.col("result_for").isNotNull()).groupBy("conv_id", F.col("result_for").alias("call_id")).agg(F.count("*").alias("n_results"))
    about = left_join(left_join(held.select(*_KEY, "turn", "n_calls"), placed, _KEY), answered, _KEY)
    about = written(about.select(*_KEY, F.col("turn").alias("first_turn"), "n_calls", "level", "dangling", "n_results", F.lit(True).alias("known")))
    kind = F.when(F.col("call_id").isNotNull(), "call").when(F.col("result_for").isNotNull(), "result").otherwise("text")
    rows = own.withColumn("kind", kind).withColumnRenamed("call_id", "own_id").withColumn("call_id", F.coalesce("own_id", "result_for"))
    # texts meet nothing and need not be dealt by identifier, which for them is null
    met = rows.where(F.col("kind") != "text").join(about, _KEY, "left")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in about.schema.fields if f.name not in _KEY]
    every = met.unionByName(rows.where(F.col("kind") == "text").select("*", *nothing))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = F.when(is_call & (F.col("turn") > F.col("first_turn")), "repeated").when(
        is_call, F.when(F.col("n_results") > 0, "answered").otherwise("unanswered")
    ).when(is_result, F.when(F.col("known"), "linked").otherwise("orphan"))
    more = F.array_compact(F.array(F.when(is_call & F.col("dangling"), "dangling"), F.when(is_call & F.col("known") & F.col("level").isNull(), "cycle")))
    errors = F.when(is_call, F.concat(problems(F.col("tool"), F.col("arguments"), schemas), more)).otherwise(F.array().cast("array<string>"))
    parts = [
        ("after", F.when(is_call, quoted(F.col("after")))), ("arguments", F.when(is_call, canonical(F.col("arguments")))),
        ("call_id", F.when(F.col("kind") != "text", quoted(F.col("call_id")))), ("content", quoted(F.col("text"))),
        ("role", quoted(F.col("role"))), ("tool", F.when(is_call, quoted(F.col("tool")))),
    ]
    message = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in parts])), ","), F.lit("}"))
    return every.select("conv_id", "turn", "role", "kind", "call_id", status.alias("status"), "level", errors.alias("errors"), message.alias("message"))
