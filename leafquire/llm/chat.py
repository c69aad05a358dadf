"""Chat formatting: tool calls linked with their results, ordered, checked and serialised."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafquire.llm.shared import discard, materialize, table

#: Turns that are ordered together; positions add up over such spans of a conversation.
SPAN = 1024

TYPES = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None),
}

#: The tools that the query's calls use, with the JSON schemas of their arguments.
TOOLS = {
    "search": {"type": "object", "required": ["query", "turn"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}},
    "lookup": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 40}, "turn": {"type": "integer"}}},
    "note": {"type": "object", "required": ["query", "turn"], "properties": {"query": {"type": "string"}, "turn": {"type": "integer", "maximum": 4}}},
}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and no escapes but the needed ones; a ValueError for numbers that JSON lacks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def read_arguments(text: str | None, schema: str | None) -> tuple[list[str], str | None]:
    """The errors of a call's arguments, and their canonical JSON (null where there is none).

    Null arguments are the value null. What is no JSON, is nested deeper than the parser
    goes, holds a number outside the range of doubles, or half of a surrogate pair, has no
    canonical form; each is an error of its call alone.
    """
    try:
        value = json.loads("null" if text is None else text, parse_constant=_refuse)
    except RecursionError:
        return ["$: nested too deep"], None
    except ValueError:
        return ["$: not JSON"], None
    try:
        written = canonical(value)
        written.encode()
        return ["$: no schema"] if schema is None else violations(value, json.loads(schema)), written
    except RecursionError:
        return ["$: nested too deep"], None
    except UnicodeEncodeError:
        return ["$: lone surrogate"], None
    except ValueError:
        return ["$: not finite"], None


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a schema; of a JSON schema the keywords below are known."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{path}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, str):
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: too long")
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value > schema.get("maximum", value) or value < schema.get("minimum", value):
            out.append(f"{path}: out of range")
    if isinstance(value, dict):
        out += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in violations(x, schema["items"], f"{path}[{i}]")]
    return out


def schemas(spark, tools: dict = TOOLS) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in tools.items()], "name string, schema string")


@F.pandas_udf(T.StructType([T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("arguments", T.StringType())]))
def _checked(arguments: pd.Series, schema: pd.Series) -> pd.DataFrame:
    text = lambda x: x if isinstance(x, str) else None  # noqa: E731  pandas may hold null as nan
    out = [read_arguments(text(a), text(s)) for a, s in zip(arguments, schema)]
    return pd.DataFrame({"errors": [e for e, _ in out], "arguments": pd.Series([t for _, t in out], dtype=object)})


@F.pandas_udf(T.StringType())
def _message(conv: pd.Series, call: pd.Series, name: pd.Series, arguments: pd.Series, result: pd.Series) -> pd.Series:
    out = []
    text = lambda x: x if isinstance(x, str) else None  # noqa: E731  pandas may hold null as nan
    for c, i, n, a, r in zip(conv, call, map(text, name), map(text, arguments), map(text, result)):
        value = {"arguments": None if a is None else json.loads(a), "call_id": i, "conversation": int(c), "name": n, "result": r}
        out.append(canonical(value))
    return pd.Series(out, dtype=object)


def order_calls(calls: DataFrame) -> DataFrame:
    """Add ``depth`` and ``position`` to ``(conv_id, call_id, parent_id, turn, ...)``.

    A call comes after its parent. Pointers to parents are doubled until all have met a
    root, so a chain of n calls takes log2(n) rounds; on the way each call gathers the
    number of its ancestors and the latest turn among them and itself. Calls that never
    meet a root stand in a circle, or below one: depth and position are null. A parent
    that is not there counts as none. Positions number each conversation from 0 by
    that turn, then depth, turn and id; they add up over spans of turns, so a long
    conversation is many tasks.
    """
    own = materialize(calls.select("conv_id", "call_id", "parent_id", F.col("turn").alias("ready"), F.lit(0).cast("long").alias("depth")))
    known = own.select("conv_id", F.col("call_id").alias("parent_id"))
    jump = materialize(
        own.join(known.withColumn("there", F.lit(True)), ["conv_id", "parent_id"], "left")
        .select("conv_id", "call_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), "ready", F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    )
    discard(own)
    left = jump.where("up IS NOT NULL").count()
    while left:
        above = jump.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("far"), F.col("ready").alias("r"), F.col("depth").alias("d"))
        over = materialize(
            jump.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "call_id", F.col("far").alias("up"),
                F.greatest("ready", "r").alias("ready"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"),
            )
        )
        discard(jump)
        jump = over
        now = jump.where("up IS NOT NULL").count()
        if now == left:
            break  # only circles are left
        left = now
    placed = jump.withColumn("depth", F.when(F.col("up").isNull(), F.col("depth"))).drop("up")
    rows = materialize(calls.join(placed, ["conv_id", "call_id"], "left").withColumn("span", F.floor(F.col("ready") / SPAN)))
    fine = rows.where("depth IS NOT NULL")
    spans = fine.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("conv_id", "span").orderBy("ready", "depth", "turn", "call_id")
    ordered = fine.withColumn("at", F.row_number().over(inside) - 1).join(spans, ["conv_id", "span"]).withColumn("position", (F.col("base") + F.col("at")).cast("long"))
    broken = rows.where("depth IS NULL").withColumn("position", F.lit(None).cast("long"))
    return ordered.drop("span", "at", "base", "ready").unionByName(broken.drop("span", "ready"))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each call, for each result without a call, and for each repeat of either.

    ``calls(conv_id, call_id, parent_id, turn, name, arguments)`` meet
    ``results(conv_id, call_id, turn, content)`` by identifier. Of repeated ids the one
    with the smallest turn counts, then the smallest content; every other one is a row of
    its own with the error ``$: repeated call`` or ``$: repeated result``, null depth and
    position, and a message of itself alone. Columns: ``conv_id, call_id, turn, name, depth,
    position, has_result, valid, errors, message``; ``message`` is the canonical JSON of
    call and result. Arguments that ``read_arguments`` finds fault with are not valid. A
    result without a call has a null name, position and validity; so has a repeated
    result, with its error. Rows without conversation or id are left out, as nothing can
    be linked with them; other columns are not read.
    """
    keys = ["conv_id", "call_id"]
    calls, calls_again = _first_of_each(calls, keys, ["turn", "parent_id", "name", "arguments"])
    results, results_again = _first_of_each(results, keys, ["turn", "content"])
    ordered = order_calls(materialize(calls))
    nothing = F.lit(None)
    both = ordered.withColumn("called", F.lit(True)).join(results.withColumnRenamed("turn", "result_turn").withColumn("has_result", F.lit(True)), keys, "full_outer")
    both = both.withColumn("repeat", nothing.cast("string"))
    again = calls_again.withColumn("called", F.lit(True)).withColumn("repeat", F.lit("$: repeated call"))
    both = both.unionByName(again, allowMissingColumns=True)
    again = results_again.withColumnRenamed("turn", "result_turn").withColumn("has_result", F.lit(True)).withColumn("repeat", F.lit("$: repeated result"))
    both = both.unionByName(again, allowMissingColumns=True).join(tools, "name", "left")
    both = both.withColumn("checked", _checked("arguments", "schema"))
    called, repeat = F.col("called").isNotNull(), F.col("repeat")
    errors = F.when(called, F.col("checked.errors"))
    return both.select(
        "conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "name", "depth", "position",
        F.coalesce("has_result", F.lit(False)).alias("has_result"),
        F.when(called, (F.size(errors) == 0) & repeat.isNull()).alias("valid"),
        F.when(repeat.isNull(), errors).otherwise(F.concat(F.coalesce(errors, F.array().cast("array<string>")), F.array(repeat))).alias("errors"),
        _message(F.col("conv_id").cast("long"), "call_id", "name", "checked.arguments", "content").alias("message"),
    )


def _first_of_each(df: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The least row of each key, and all others, one by one; equal rows are counted before they are shuffled."""
    whole = df.select(*keys, *fields).where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    row = F.struct(*fields)
    counted = whole.groupBy(*keys, *fields).agg(F.count("*").alias("n"))
    several = materialize(whole.groupBy(*keys).agg(F.min(row).alias("x"), F.count("*").alias("n")))
    others = counted.join(several.where("n > 1").select(*keys, "x"), keys)
    extra = F.col("n") - F.when(row.eqNullSafe(F.col("x")), 1).otherwise(0)
    others = others.withColumn("k", F.explode(F.when(extra > 0, F.sequence(F.lit(1).cast("long"), extra)).otherwise(F.array().cast("array<bigint>"))))
    return several.select(*keys, "x.*"), others.select(*keys, *fields)


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a table of turns.

    A user turn calls a tool, picked by the length of its text, and follows from the
    turn two before; an assistant turn answers the turn before it.
    """
    key = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    turn = F.col("turn")
    size = F.length(F.coalesce("text", F.lit("")))
    name = F.element_at(F.array(*[F.lit(k) for k in ("search", "lookup", "note")]), (size % 3 + 1).cast("int"))
    arguments = F.to_json(F.struct(turn.alias("turn"), F.coalesce("text", F.lit("")).alias("query")))
    user = turns.where("role = 'user'").select("conv_id", key(turn).alias("call_id"), key(turn - 2).alias("parent_id"), "turn", name.alias("name"), arguments.alias("arguments"))
    answers = turns.where("role = 'assistant'").select("conv_id", key(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return user, answers


def op1_chat(spark, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations"))
    out = link(calls, results, schemas(spark))
    return out.select("conv_id", "call_id", "turn", "name", "depth", "position", "has_result", "valid", F.array_join("errors", "; ").alias("errors"), "message")
