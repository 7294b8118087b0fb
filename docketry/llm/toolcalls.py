"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

``calls``: ``conv, turn, call_id, name, arguments`` (JSON text), ``after``
(array of call ids of the same conversation that come first).
``results``: ``conv, turn, call_id, content``.

- Calls and results meet in a hash join on conversation and call id. Of repeated
  ids the lowest turn (then text) is linked; the others stay, as
  ``duplicate_call`` or ``duplicate_result``. A result without a call is an
  ``orphan_result``.
- The order of a conversation is by ``phase, level, turn, call_id``. Calls that
  only wait for earlier turns are in order already (phase 0). The others, and
  what waits for them, get the level that peeling would give (phase 1): chains of
  single waits are cut short by doubling, and calls with several waits are peeled
  over what is left; calls on a cycle, or behind one, come last
  (phase 2). There is one row per call, so a conversation of any size is never
  gathered; sort by these columns to read it.
- Arguments are checked against the schema of their tool: types, required and
  unknown fields, enumerations, bounds, items.
- Canonical JSON: keys by UTF-16 code units, no white space, shortest numbers.

Defined results: null ids are linked to nothing (``missing_id``); null or broken
arguments, and such with lone surrogates or more than ``MAX_DEPTH`` levels, are
``invalid_json`` and stay as text; an unknown or null tool is ``unknown_tool``; a
wait for an unknown call or for itself is ignored and counted in
``unknown_waits``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import materialize
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

#: levels of arrays and objects in arguments; far below what the interpreter allows
MAX_DEPTH = 100


def _number(value: int | float) -> str:
    if isinstance(value, int):
        return str(value)
    if not math.isfinite(value):
        raise ValueError("not a JSON number")
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    digits, _, exponent = repr(value).partition("e")
    if not exponent:
        return digits
    if -7 < int(exponent) < 0:
        return f"{value:.{len(digits.replace('.', '').lstrip('-')) - 1 - int(exponent)}f}"
    return f"{digits}e{'+' if int(exponent) > 0 else '-'}{abs(int(exponent))}"


def canonical(value: object) -> str:
    """JSON text that is the same for equal values."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _refuse(text: str) -> None:
    raise ValueError(text)


def _check(value: object) -> None:
    """Nesting within ``MAX_DEPTH``, and every text without lone surrogates; level by level, so no depth is too much."""
    level, depth = [value], 0
    while level:
        depth += any(isinstance(v, (dict, list)) for v in level)
        if depth > MAX_DEPTH:
            raise ValueError("nested too deeply")
        for v in level:
            for text in v if isinstance(v, dict) else [v] if isinstance(v, str) else ():
                text.encode()
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]


def parse(text: str | None) -> object:
    """Strict JSON: no repeated keys, no NaN, no lone surrogates, at most ``MAX_DEPTH`` levels."""
    if text is None:
        raise ValueError("null")
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    _check(value)
    canonical(value)
    return value


_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def faults(value: object, schema: dict, path: str = "$") -> Iterator[str]:
    """What is wrong with a value, as ``path rule``."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or list(_TYPES)
    if not any(_TYPES[k](value) for k in kinds):
        yield f"{path} type"
        return
    if "enum" in schema and not any(type(value) is type(e) and value == e for e in schema["enum"]):
        yield f"{path} enum"
    if _TYPES["number"](value):
        if value < schema.get("minimum", value):
            yield f"{path} minimum"
        if value > schema.get("maximum", value):
            yield f"{path} maximum"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        yield f"{path} length"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            yield from faults(item, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{path}.{k} required" for k in sorted(schema.get("required", ())) if k not in value)
        if schema.get("additionalProperties", True) is False:
            yield from (f"{path}.{k} unknown" for k in sorted(value) if k not in known)
        for k in sorted(known):
            if k in value:
                yield from faults(value[k], known[k], f"{path}.{k}")


def _firsts(rows: DataFrame, order: list[str]) -> DataFrame:
    """The numbers of the rows that are the first of their conversation and call id, found by aggregation."""
    known = rows.where("conv is not null and call_id is not null")
    return known.groupBy("conv", "call_id").agg(F.min(F.struct(*order, "number")).alias("first")).select("first.number")


def _levels(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """``conv, call_id, level`` of the calls on no cycle and behind none: the longest chain of waits below each.

    A call with one wait is as high as the end of its chain plus the way there;
    ways double in every round. Calls with several waits are peeled, over the
    ends of the chains below them.
    """
    key, dep = ["conv", "call_id"], ["conv", "dep"]
    counted = materialize(waits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("dep").alias("dep")), "wait-counts")
    single = counted.where("n = 1").select(*key, "dep", F.lit(1).alias("way"))
    inside = counted.where("n = 1").select("conv", F.col("call_id").alias("dep"), F.lit(False).alias("ended"))
    way = materialize(single.join(inside, dep, "left").select(*key, "dep", "way", F.coalesce("ended", F.lit(True)).alias("ended")), "ways")
    longest, reach = way.groupBy("conv").count().agg(F.max("count")).first()[0] or 0, 1
    while reach < longest and not way.where("NOT ended").isEmpty():
        onward = way.select("conv", F.col("call_id").alias("dep"), F.col("dep").alias("end"), F.col("way").alias("rest"), F.col("ended").alias("over"))
        longer = way.where("NOT ended").join(onward, dep).select(
            *key, F.col("end").alias("dep"), (F.col("way") + F.col("rest")).alias("way"), F.col("over").alias("ended")
        )
        way, reach = materialize(way.where("ended").unionByName(longer), "ways"), 2 * reach
    # ways that never end are on a cycle or behind one; no call there is ever placed
    below = way.select("conv", F.col("call_id").alias("dep"), F.col("dep").alias("end"), "way")
    inner = waits.join(counted.where("n > 1").select(*key), key, "left_semi").join(below, dep, "left").select(
        *key, F.coalesce("end", "dep").alias("dep"), (F.coalesce("way", F.lit(0)) + 1).alias("way"), F.lit(None).cast("int").alias("at")
    )
    inner = materialize(inner, "several-waits")
    ready = materialize(calls.join(counted, key, "left_anti").select(*key, F.lit(0).alias("level")), "ready")
    placed = ready
    while not ready.isEmpty():
        reached = ready.select("conv", F.col("call_id").alias("dep"), F.col("level").alias("met"))
        inner = materialize(
            inner.join(reached, dep, "left").select(*key, "dep", "way", F.coalesce("at", F.col("met") + F.col("way")).alias("at")), "several-waits"
        )
        judged = inner.groupBy(*key).agg(F.max("at").alias("level"), F.count_if(F.col("at").isNull()).alias("open"))
        ready = materialize(judged.where("open = 0").select(*key, "level"), "ready")
        inner = inner.join(ready, key, "left_anti")
        placed = placed.unionByName(ready)
    ends = placed.select("conv", F.col("call_id").alias("dep"), "level")
    return placed.unionByName(way.where("ended").join(ends, dep).select(*key, (F.col("level") + F.col("way")).alias("level")))


def order_calls(calls: DataFrame) -> DataFrame:
    """``conv, call_id, turn, after`` (ids unique) to ``conv, call_id, phase, level, unknown_waits``."""
    node = materialize(calls.select("conv", "call_id", "turn", "after"), "calls")
    wait = node.select("conv", "call_id", "turn", F.explode(F.array_distinct("after")).alias("dep"))
    known = node.select("conv", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"))
    edges = materialize(
        wait.where("dep <> call_id").join(known, ["conv", "dep"]).select(
            "conv", "call_id", "dep",
            (F.struct("dep_turn", F.col("dep").alias("id")) < F.struct(F.col("turn").alias("dep_turn"), F.col("call_id").alias("id"))).alias("back"),
        ),
        "waits",
    )
    # calls that wait for a later place, and all that wait for those
    open_calls = materialize(edges.where("NOT back").select("conv", "call_id").distinct(), "open-calls")
    frontier = open_calls
    while not frontier.isEmpty():
        behind = edges.join(frontier.withColumnRenamed("call_id", "dep"), ["conv", "dep"]).select("conv", "call_id").distinct()
        frontier = materialize(behind.join(open_calls, ["conv", "call_id"], "left_anti"), "frontier")
        open_calls = materialize(open_calls.unionByName(frontier), "open-calls")
    inner = edges.join(open_calls, ["conv", "call_id"], "left_semi").join(
        open_calls.withColumnRenamed("call_id", "dep"), ["conv", "dep"], "left_semi"
    )
    level = _levels(open_calls, materialize(inner.select("conv", "call_id", "dep"), "open-waits"))
    placed = open_calls.join(level, ["conv", "call_id"], "left").select(
        "conv", "call_id", F.when(F.col("level").isNull(), 2).otherwise(1).alias("phase"), F.coalesce("level", F.lit(0)).alias("level")
    )
    unknown = (
        wait.join(known, ["conv", "dep"], "left").where("dep_turn IS NULL OR dep = call_id OR dep IS NULL")
        .groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("unknown_waits"))
    )
    out = node.select("conv", "call_id").join(placed, ["conv", "call_id"], "left").join(unknown, ["conv", "call_id"], "left")
    return out.select(
        "conv", "call_id", F.coalesce("phase", F.lit(0)).alias("phase"), F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("unknown_waits", F.lit(0)).alias("unknown_waits"),
    )


def _formatting(schemas: dict[str, dict]):
    def one(r: dict) -> tuple[str | None, str | None, str]:
        if r["call_status"] == "orphan_result" or r["call_status"] == "duplicate_result":
            return None, None, canonical({"id": r["call_id"], "result": r["content"], "role": "tool"})
        message = {"id": r["call_id"], "name": r["name"], "role": "assistant"}
        try:
            value = parse(r["arguments"])
        except ValueError:
            state, found, message["arguments"] = "invalid_json", [], r["arguments"]
        else:
            message["arguments"] = value
            schema = schemas.get(r["name"])
            found = [] if schema is None else list(faults(value, schema))
            state = "unknown_tool" if schema is None else "invalid" if found else "valid"
        if r["linked"]:
            message["result"] = r["content"]
        return state, ";".join(found), canonical(message)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(r) for r in batch.to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 3
            added = [pa.array(c, pa.string()) for c in columns]
            names = [*batch.schema.names, "arguments_status", "faults", "message"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return run


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per result that no call took: link, place, check and canonical JSON."""
    known = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    called = calls.select("conv", "turn", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    called = materialize(called.withColumn("number", F.monotonically_increasing_id()), "calls")
    taken = _firsts(called, ["turn", "name", "arguments"])
    given = results.select("conv", F.col("turn").alias("result_turn"), "call_id", "content")
    given = materialize(given.withColumn("number", F.monotonically_increasing_id()), "results")
    answered = _firsts(given, ["result_turn", "content"])
    first = materialize(called.join(taken, "number", "left_semi").drop("number"), "first-calls")
    place = order_calls(first)
    linked = first.join(place, ["conv", "call_id"]).join(
        given.join(answered, "number", "left_semi").select("conv", "call_id", "result_turn", "content", F.lit(True).alias("taken")),
        ["conv", "call_id"], "full",
    )
    none = F.lit(None)
    status = F.when(F.col("phase").isNull(), "orphan_result").when(F.col("taken").isNull(), "missing_result").otherwise("linked")
    main = linked.withColumn("call_status", status)
    more_calls = called.join(taken, "number", "left_anti").withColumn(
        "call_status", F.when(known, "duplicate_call").otherwise("missing_id")
    )
    more_results = given.join(answered, "number", "left_anti").withColumn(
        "call_status", F.when(known, "duplicate_result").otherwise("orphan_result")
    )
    columns = {
        "conv": "conv", "turn": "turn", "call_id": "call_id", "name": "name", "arguments": "arguments", "phase": "phase",
        "level": "level", "unknown_waits": "unknown_waits", "result_turn": "result_turn", "content": "content", "call_status": "call_status",
    }

    def shaped(df: DataFrame) -> DataFrame:
        kinds = {"turn": "long", "phase": "int", "level": "int", "unknown_waits": "long", "result_turn": "long"}
        return df.select(*[(F.col(c) if c in df.columns else none).cast(kinds.get(c, "string") if c != "conv" else df.schema["conv"].dataType).alias(c) for c in columns])

    rows = shaped(main).unionByName(shaped(more_calls)).unionByName(shaped(more_results))
    rows = rows.withColumn("linked", F.col("call_status") == "linked")
    added = [T.StructField(n, T.StringType()) for n in ("arguments_status", "faults", "message")]
    schema = T.StructType([*rows.schema.fields, *added])
    return rows.mapInArrow(_formatting(schemas), schema).drop("arguments", "content", "linked")


#: what the registered query validates against
TOOLS = {
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
    },
    "convert": {
        "type": "object", "required": ["amount", "unit"],
        "properties": {"amount": {"type": "number", "minimum": 0}, "unit": {"type": "string", "enum": ["m", "km", "mile"]}},
    },
    "fetch": {
        "type": "object", "required": ["pages"],
        "properties": {"pages": {"type": "array", "items": {"type": "integer", "minimum": 0}}, "raw": {"type": "boolean"}},
    },
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as a conversation table implies them.

    An assistant turn is a call whose arguments come from its text; the next
    user turn is its result. Turns of other roles (or none) take no call id, so they
    come out as results without a call. A call waits for the assistant turn before it; in
    every seventh conversation for the one after it, in every 29th for both.
    """
    c = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv").cast("string"), F.lit("-"), turn.cast("string"))
    n = F.char_length("text").cast("long")
    kind = F.pmod(F.col("conv") + F.col("turn"), F.lit(4))
    pick = F.element_at(F.array(*map(F.lit, ("m", "km", "mile", "yard"))), (n % 4 + 1).cast("int"))
    arguments = (
        F.when(n % 31 == 0, F.lit("{broken"))
        .when(kind == 0, F.to_json(F.struct((n % 60).alias("limit"), F.col("text").alias("query"))))
        .when(kind == 1, F.to_json(F.struct(pick.alias("unit"), (n / 8).alias("amount"))))
        .when(kind == 2, F.to_json(F.struct(F.array(n % 5, n % 7 - 1).alias("pages"), (n % 2 == 0).alias("raw"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("body"))))
    )
    tool = F.element_at(F.array(*map(F.lit, ("search", "convert", "fetch", "write"))), (kind + 1).cast("int"))
    before, later = name(F.col("turn") - 2), name(F.col("turn") + 2)
    after = F.when(F.col("conv") % 29 == 0, F.array(before, later)).when(F.col("conv") % 3 == 0, F.array(later)).otherwise(F.array(before))
    calls = c.where("role = 'assistant'").select("conv", "turn", name(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = c.where("role is null or role <> 'assistant'").select(
        "conv", "turn", F.when(F.col("role") == "user", name(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results
