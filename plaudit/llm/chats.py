"""Tool calls of chats linked with their results, ordered, checked and serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plaudit.llm.common import numbered
from plaudit.operators.skew import counts_of, hot_keys, split_join
from plaudit.sources.shared import saved

_TYPES = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
}


def conforms(value, schema: dict) -> bool:
    """Whether a value fits a JSON schema of type, enum, minLength, items, required, properties and
    additionalProperties."""
    kinds = schema.get("type", list(_TYPES))
    if not any(_TYPES[kind](value) for kind in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return False
    if isinstance(value, list):
        return all(conforms(item, schema.get("items", {})) for item in value)
    if isinstance(value, dict):
        own = schema.get("properties", {})
        if any(name not in value for name in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and set(value) - set(own):
            return False
        return all(conforms(item, own[name]) for name, item in value.items() if name in own)
    return True


def canonical(value) -> str:
    """JSON with sorted names, no spaces and no escapes that are not needed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _levels(calls: DataFrame) -> DataFrame:
    """``node, level``: how many calls must come one after the other before this one; null in or behind a cycle.

    Calls with one need stand in chains: each points to its need and, round by round, to where that one
    points, so a chain is walked in the logarithm of its length. Left are the calls that need
    none or several: they leave in Kahn's order, as many rounds as the longest chain of calls with several needs.
    """
    nodes = calls.select("node")
    needs = calls.select("node", "conv_id", F.explode("needs").alias("call_id")).distinct()
    known = calls.select("conv_id", "call_id", F.col("node").alias("on"))
    edges = saved(needs.join(known, ["conv_id", "call_id"]).select("node", "on"))
    single = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("on").alias("on")).where("n = 1").select("node", "on")
    chain = saved(single.withColumn("steps", F.lit(1).cast("long")))
    ends = saved(nodes.join(chain, "node", "left_anti"))
    zero = F.lit(0).cast("long")
    rounds = max(1, chain.count()).bit_length() + 1
    for _ in range(rounds):
        places = chain.unionByName(ends.select("node", F.col("node").alias("on"), zero.alias("steps")))
        places = places.select(F.col("node").alias("on"), F.col("on").alias("next"), F.col("steps").alias("more"))
        moved = split_join(chain, places, ["on"], hot_keys(counts_of(chain, ["on"])), ["node"])
        moved = saved(moved.select("node", F.col("next").alias("on"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("goes_on")))
        chain = moved.drop("goes_on")
        if not moved.where("goes_on").limit(1).count():
            break
    # Who has not reached an end by now never will: its chain runs in a circle.
    chain = chain.join(ends.withColumnRenamed("node", "on"), "on", "left_semi")

    lead = chain.select(F.col("node").alias("on"), F.col("on").alias("end"), "steps")
    several = edges.join(ends, "node", "left_semi").join(lead, "on", "left")
    waits = F.coalesce("steps", zero) + 1
    open_ = saved(several.select("node", F.coalesce("end", "on").alias("on"), waits.alias("waits")))
    done = saved(ends.join(open_.select("node").distinct(), "node", "left_anti").withColumn("level", zero))
    last = done
    reached = None
    while open_.limit(1).count():
        met = open_.join(last.withColumnRenamed("node", "on"), "on").select("node", (F.col("level") + F.col("waits")).alias("level"))
        reached = met if reached is None else reached.unionByName(met)
        left = saved(open_.join(last.select(F.col("node").alias("on")), "on", "left_anti"))
        reached = saved(reached)
        free = reached.join(left.select("node").distinct(), "node", "left_anti").groupBy("node").agg(F.max("level").alias("level"))
        last = saved(free)
        if not last.limit(1).count():
            break
        done = done.unionByName(last)
        reached = reached.join(last.select("node"), "node", "left_anti")
        open_ = left
    # Many calls may need the same one.
    followers = split_join(chain, done.withColumnRenamed("node", "on"), ["on"], hot_keys(counts_of(chain, ["on"])), ["node"])
    done = done.unionByName(followers.select("node", (F.col("level") + F.col("steps")).alias("level")))
    return nodes.join(done, "node", "left")


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``conv_id, call_id, level, position, status, line`` for each call, and each result without one.

    ``calls(conv_id, call_id, name, arguments, needs)`` and ``results(conv_id, call_id, content)``
    meet by a hash join on the identifiers. Calls come after the calls whose results they need;
    ``level`` is the longest chain before a call, and ``position`` numbers a conversation's calls
    in that order, ties by a hash. Arguments are JSON, checked against the schema of their name.
    ``line`` is the canonical JSON of the call with its result.

    ``status`` is the first that holds of: ``orphan`` (a result of no call), ``cycle`` (needs itself
    in the end; no level, last positions), ``unknown_tool``, ``invalid`` (arguments that are no JSON
    or not of the schema), ``missing_need`` (needs a call that is not there), ``no_result``, ``ok``.
    Of repeated calls or results of one identifier the one with the least content counts. Rows
    without a conv_id or call_id are left out: nothing can refer to them. Null arguments are
    invalid, a null content is a result. Arguments that are not JSON are kept as text.
    """
    key = ["conv_id", "call_id"]
    least = F.min(F.struct("name", "arguments", "needs")).alias("c")
    asked = calls.select(*key, "name", "arguments", F.array_sort(F.coalesce("needs", F.array().cast("array<string>"))).alias("needs"))
    asked = asked.where("conv_id is not null and call_id is not null").groupBy(*key).agg(least).select(*key, "c.*")
    node = F.md5(F.to_json(F.struct(*key)).cast("binary"))
    asked = saved(asked.withColumn("node", node))
    given = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("content")).alias("result"))
    levels = _levels(asked)
    known = asked.select("conv_id", F.col("call_id").alias("need"))
    absent = (
        asked.select("node", "conv_id", F.explode("needs").alias("need"))
        .join(known, ["conv_id", "need"], "left_anti")
        .select("node", F.lit(True).alias("absent"))
        .distinct()
    )
    linked = asked.join(levels, "node").join(absent, "node", "left").join(given, key, "full_outer").drop("node")
    linked = saved(linked.withColumn("rank", F.coalesce(F.when(F.col("name").isNull() & F.col("needs").isNull(), F.lit(1 << 62)), "level", F.lit(1 << 61))))
    placed = _in_order(linked)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, states, lines = batch.to_pylist(), [], []
            for row in rows:
                result = row["result"]
                orphan = row["needs"] is None
                try:
                    arguments, parsed = json.loads(row["arguments"]), True
                    line_arguments = arguments
                    canonical(arguments)
                except (TypeError, ValueError, RecursionError):
                    arguments, parsed, line_arguments = None, False, row["arguments"]
                schema = schemas.get(row["name"])
                states.append(
                    "orphan" if orphan
                    else "cycle" if row["level"] is None
                    else "unknown_tool" if schema is None
                    else "invalid" if not parsed or not conforms(arguments, schema)
                    else "missing_need" if row["absent"]
                    else "no_result" if result is None
                    else "ok"
                )
                call = {"id": row["call_id"], "result": None if result is None else {"content": result["content"]}}
                if not orphan:
                    call |= {"arguments": line_arguments, "name": row["name"], "needs": row["needs"]}
                lines.append(canonical(call))
            at = {name: i for i, name in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[n]) for n in ("conv_id", "call_id", "level", "position")] + [pa.array(states, pa.string()), pa.array(lines, pa.string())],
                names=["conv_id", "call_id", "level", "position", "status", "line"],
            )

    kind = dict(calls.dtypes)["conv_id"]
    return placed.mapInArrow(write, f"conv_id {kind}, call_id string, level long, position long, status string, line string")


def _in_order(linked: DataFrame) -> DataFrame:
    """Positions by rank, then by a hash: numbered within each rank, after the counts of lower ones."""
    before = Window.partitionBy("conv_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counts = linked.groupBy("conv_id", "rank").agg(F.count("*").alias("n"))
    starts = counts.select("conv_id", "rank", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = numbered(linked, ["conv_id", "rank"], ["call_id"], "own")
    return own.join(starts, ["conv_id", "rank"]).withColumn("position", F.col("start") + F.col("own")).drop("own", "start", "rank")


# The tool that the turns of a conversation stand for, see ``calls_of_turns``.
TURN_SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}},
    }
}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats: a user's turn asks, the assistant's turn after it answers.

    Every later call of a conversation needs the result of its first one. Rows without a turn stand
    nowhere: a user's is a call with an identity of its own and arguments that lack the turn, an
    assistant's a result of no call.
    """
    ident = F.format_string("call-%d-%d", "conv_id", "turn")
    mark = F.md5(F.coalesce("text", F.lit("-")).cast("binary"))
    astray = conversations.where("turn is null and conv_id is not null").select("conv_id", "role", "text", mark.alias("mark"))
    astray = numbered(astray, ["conv_id", "role", "mark"], ["mark"], "number")
    own = F.concat_ws("-", F.lit("astray"), "mark", F.col("number").cast("string")).alias("call_id")
    nothing = F.array().cast("array<string>")

    asked = conversations.where("role = 'user' and conv_id is not null and turn is not null")
    first = asked.groupBy("conv_id").agg(F.min("turn").alias("first"))
    calls = asked.join(first, "conv_id").select(
        "conv_id",
        ident.alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.when(F.col("turn") > F.col("first"), F.array(F.format_string("call-%d-%d", "conv_id", "first"))).otherwise(nothing).alias("needs"),
    )
    arguments = F.to_json(F.struct(F.col("text").alias("prompt")))
    more = astray.where("role = 'user'").select("conv_id", own, F.lit("reply").alias("name"), arguments.alias("arguments"), nothing.alias("needs"))
    before = F.format_string("call-%d-%d", F.col("conv_id"), F.col("turn") - 1)
    answers = conversations.where("role = 'assistant' and turn is not null")
    results = answers.select("conv_id", before.alias("call_id"), F.col("text").alias("content"))
    lost = astray.where("role = 'assistant'").select("conv_id", own, F.col("text").alias("content"))
    return calls.unionByName(more), results.unionByName(lost)
