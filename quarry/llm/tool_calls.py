"""Tool calls of conversations: link, order, validate, serialise.

Calls and results are joined by identifier. A call may name another one that it depends
on; the depth of a call is the length of that chain, found by pointer doubling (each round
doubles how far a call has looked back), and calls sorted by (conversation, depth,
position) are in topological order. A cycle has no depth. Arguments are JSON; a schema
gives each field's type and whether it is required. Output is canonical JSON: keys sorted,
no white space, null written out.

DataFrame functions only. No step needs the rows of a conversation together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: JSON types of a schema, as variants report them.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}

#: The schema of the calls that chat_calls() makes: field -> (type, required).
CHAT_SCHEMAS = {"reply": {"text": ("string", True), "turn": ("integer", True)}}

TURNS = 256


def depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """call_id, depth of unique calls (call_id, depends_on): 0 without a known predecessor,
    null in and behind a cycle."""
    known = calls.select(F.col("call_id").alias("depends_on"), F.lit(True).alias("known"))
    state = calls.select("call_id", "depends_on").join(known, "depends_on", "left")
    back = F.when(F.col("known"), F.col("depends_on"))
    state = scratch.save(state.select("call_id", back.alias("back"), F.when(back.isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "depth-0")
    open_, turn = state.filter("back is not null").count(), 0
    rounds = math.ceil(math.log2(open_ + 1)) + 1
    while open_ and turn < rounds:
        turn += 1
        far = state.select(F.col("call_id").alias("back"), F.col("back").alias("far"), F.col("depth").alias("more"))
        step = state.join(far, "back", "left").select("call_id", F.col("far").alias("back"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = scratch.save(step, f"depth-{turn}")
        open_ = state.filter("back is not null").limit(1).count()
        if turn > 1:
            scratch.drop(f"depth-{turn - 2}")
    return state.select("call_id", F.when(F.col("back").isNull(), F.col("depth")).alias("depth"))


def valid_arguments(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether arguments (variant) has the fields that the schema of `name` asks for."""
    out = F.lit(False)
    for tool, fields in schemas.items():
        ok = F.lit(True)
        for field, (kind, required) in fields.items():
            got = F.regexp_extract(F.coalesce(F.schema_of_variant(F.try_variant_get(arguments, f"$.{field}", "variant")), F.lit("")), "^[A-Z]*", 0)
            ok = ok & (got.isin(TYPES[kind]) if required else got.isin([*TYPES[kind], "", "VOID"]))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out & F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT")), F.lit(False))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, call_id, depends_on, depth, position, name, n_calls, n_results, valid, status, json.

    calls: conv_id, call_id, depends_on, position, name, arguments (JSON text); results:
    call_id, position, content. Of several calls with one identifier the smallest in
    (position, name, arguments) stands for all, and n_calls tells how many there were; the
    first result answers, and n_results tells how many there are. Calls without identifier
    are left out. status: ok, invalid, unanswered or cycle, the last of these that holds.
    Results of unknown calls are dropped. Empty tables give no rows.
    """
    scratch = Scratch(calls.sparkSession, "calls")
    own = F.struct(F.col("position"), F.col("name"), F.col("arguments"), F.col("conv_id"), F.col("depends_on"))
    unique = calls.filter("call_id is not null").groupBy("call_id").agg(F.min(own).alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls")
    unique = scratch.save(unique, "calls")
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("position", "content")).alias("r"), F.count("*").alias("n_results"))
    joined = unique.hint("shuffle_hash").join(answers.hint("shuffle_hash"), "call_id", "left").join(depths(unique, scratch), "call_id")
    parsed = joined.withColumn("arg", F.try_parse_json("arguments"))
    valid = valid_arguments(F.col("name"), F.col("arg"), schemas)
    status = F.when(F.col("depth").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").when(~valid, "invalid").otherwise("ok")
    text = F.to_json(F.struct(F.col("arg").alias("arguments"), "call_id", "depends_on", "name", F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    return parsed.select(
        "conv_id", "call_id", "depends_on", "depth", "position", "name", "n_calls",
        F.coalesce("n_results", F.lit(0)).alias("n_results"), valid.alias("valid"), status.alias("status"), text.alias("json"),
    )


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table of turns (conv_id, turn, role, text).

    Each user turn is a call of `reply`, which depends on the conversation's user turn
    before it; each assistant turn is a result of the last user turn before it. Rows
    without conv_id or turn cannot be placed and are left out; other roles take no part.
    The turn before is found in ranges of TURNS turns and by their last user turns, so that
    one long conversation is not one task.
    """
    placed = conversations.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    placed = placed.withColumn("range", F.floor(F.col("turn") / TURNS))
    user = F.when(F.col("role") == "user", F.col("turn"))
    inside = Window.partitionBy("conv_id", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("conv_id", "range").agg(F.max(user).alias("last"))
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("conv_id", "range", F.max("last").over(ahead).alias("carried"))
    df = placed.withColumn("near", F.max(user).over(inside)).join(carried, ["conv_id", "range"]).withColumn("before", F.coalesce("near", "carried"))
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    calls = df.filter("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("before")).alias("depends_on"), F.col("turn").alias("position"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = df.filter("role = 'assistant' and before is not null").select(name(F.col("before")).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


SQL = """
with t as (select conv_id, turn, role, text, max(case when role = 'user' then turn end) over (partition by conv_id order by turn range between unbounded preceding and 1 preceding) before
  from conversations where conv_id is not null and turn is not null),
c as (select conv_id, turn, any_value(before) before, min(text) text, count(*) n_calls from t where role = 'user' group by conv_id, turn),
d as (select *, row_number() over (partition by conv_id order by turn) - 1 depth from c),
r as (select conv_id, before turn, count(*) n_results, min({'t': turn, 'c': text}) r from t where role = 'assistant' and before is not null group by conv_id, before)
select d.conv_id, concat(d.conv_id, ':', d.turn) call_id, case when before is not null then concat(d.conv_id, ':', before) end depends_on, depth, d.turn as "position", 'reply' "name", n_calls,
  coalesce(n_results, 0) n_results, text is not null "valid", case when n_results is null then 'unanswered' when text is null then 'invalid' else 'ok' end "status",
  cast(to_json({'arguments': {'text': text, 'turn': d.turn}, 'call_id': concat(d.conv_id, ':', d.turn), 'depends_on': case when before is not null then concat(d.conv_id, ':', before) end, 'name': 'reply', 'result': r.c}) as varchar) "json"
from d left join (select conv_id, turn, n_results, r.c c from r) r using (conv_id, turn)
"""
