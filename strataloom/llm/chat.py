"""Chat formatting (operator 2): tool-call linking.

A message is a JSON call list ({"tool_calls": [{"id", "name", "arguments", "depends_on"?}]} of an assistant), a JSON result
({"tool_call_id", "content"} of a tool) or plain text. Calls and results are hash-joined by (conversation, identifier); the
first call of an identifier counts. Messages are put in topological order: a result after its call, a call after the results
it depends on; among free ones the turn decides. Arguments are validated against the tool's schema. Each part is one row with
canonical JSON (sorted keys, no spaces), so no conversation, however long, is gathered in one task. Only the skeleton of
calls that depend on others, (identifier, what it needs) pairs, is sorted in one task for each conversation; a conversation
with more than ``skeleton`` such pairs is sorted by rounds of joins over the whole cluster instead, with the same result.

Defined results: null text is empty, null role is "user"; unreadable JSON (also NaN, Infinity and numbers beyond a double) is
plain text; a lone surrogate is written as its \\u escape; a result without a call carries ``result:no-call``; a call in a
dependency cycle, or behind one, carries ``call:unresolvable`` and keeps its turn's place; of calls with equal identifiers in
a conversation all but those of the first turn carry ``call:repeated``; repeated rows each give their parts; equal turns are
ties that keep equal places; a null conversation or turn is kept, and its calls link to nothing; texts of any length are read
whole; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_row

#: Argument schemas of known tools, in the usual JSON form (type, properties, required, enum, items).
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def _refuse(x: str):
    raise ValueError(f"not a number of JSON: {x}")


def _number(x: str) -> float:
    value = float(x)
    return value if math.isfinite(value) else _refuse(x)


def read_json(text: str):
    """The value, or ValueError: also where it could not be written again as canonical JSON."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_number)
        canonical([[[value]]])
    except RecursionError:
        raise ValueError("too deep") from None
    return value


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema; a type may be a list of alternatives."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"type:{at}"]
    out = [f"enum:{at}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"missing:{at}.{k}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"unknown:{at}.{k}" for k in value if k not in properties]
        for k, v in value.items():
            if k in properties:
                out += violations(v, properties[k], f"{at}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{k}]")
    return out


def message_parts(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(part, kind, role, call_id, depends, errors, json) of a message."""
    role, text = role or "user", text or ""
    body = None
    if text.lstrip()[:1] == "{" and role in ("assistant", "tool"):
        try:
            body = read_json(text)
        except ValueError:
            body = None
    if role == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list) and all(isinstance(c, dict) for c in body["tool_calls"]):
        out = []
        for k, call in enumerate(body["tool_calls"]):
            name, arguments, errors = call.get("name"), call.get("arguments", {}), []
            if isinstance(arguments, str):
                try:
                    arguments = read_json(arguments)
                except ValueError:
                    errors.append("arguments:json")
            if not isinstance(name, str) or name not in schemas:
                errors.append("tool:unknown")
            elif not errors:
                errors += violations(arguments, schemas[name])
            if call.get("id") is None:
                errors.append("call:no-id")
            needs = [str(x) for x in call["depends_on"]] if isinstance(call.get("depends_on"), list) else []
            shown = {"role": role, "tool_call": {"id": call.get("id"), "name": name, "arguments": arguments}}
            out.append((k, "call", role, None if call.get("id") is None else str(call["id"]), sorted(set(needs)), errors, canonical(shown)))
        return out or [(0, "message", role, None, [], [], canonical({"role": role, "content": ""}))]
    if role == "tool" and isinstance(body, dict) and body.get("tool_call_id") is not None:
        of = str(body["tool_call_id"])
        return [(0, "result", role, of, [of], [], canonical({"role": role, "tool_call_id": body["tool_call_id"], "content": body.get("content")}))]
    return [(0, "message", role, None, [], ["result:no-id"] if role == "tool" else [], canonical({"role": role, "content": text}))]


def chat_format(df: DataFrame, schemas: dict | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", skeleton: int = 20_000) -> DataFrame:
    """conv, turn, part, kind, role, call_id, call_turn, linked, level, place, valid, errors, json, json_sha256 of every message part.

    Sorting a conversation by (place, level, turn, part) gives its topological order.
    """
    schemas = SCHEMAS if schemas is None else schemas

    def clean(x: str | None) -> str | None:
        return x and _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", x)

    def make():
        def parts_of(r, x):
            out = []
            for part, kind, own, call_id, depends, errors, shown in message_parts(r, x, schemas):
                out.append({"part": part, "kind": kind, "role": clean(own), "call_id": clean(call_id), "depends": [*map(clean, depends)], "errors": [*map(clean, errors)], "json": shown, "json_sha256": hashlib.sha256(shown.encode()).hexdigest()})
            return out

        return lambda roles, texts: (list(map(parts_of, roles, texts)),)

    one = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    fields = "part: int, kind: string, role: string, call_id: string, depends: array<string>, errors: array<string>, json: string, json_sha256: string"
    parts = per_row(one, ["conv", "turn"], ["role", "text"], f"parts array<struct<{fields}>>", make).select("conv", "turn", F.inline("parts"))
    linked = parts.filter("kind != 'message'")
    order = levels(linked, skeleton)
    # Parts without an identifier take no part in the join; they would all share the null key.
    own = linked.filter("call_id is not null").join(order, ["conv", "call_id", "kind"], "left").select(*parts.columns, "call_turn", "level", "place")
    free = parts.filter("kind = 'message' or call_id is null").select("*", F.lit(None).cast("long").alias("call_turn"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("place"))
    found = own.unionByName(free)
    result = F.col("kind") == "result"
    errors = F.array_compact(F.concat("errors", F.array(
        F.when(result & F.col("call_turn").isNull(), "result:no-call"),
        F.when((F.col("kind") == "call") & F.col("level").isNull() & F.col("call_id").isNotNull() & F.col("conv").isNotNull(), "call:unresolvable"),
        F.when((F.col("kind") == "call") & (F.col("turn") > F.col("call_turn")), "call:repeated"))))
    return found.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), "part", "kind", "role", "call_id", "call_turn", (result & F.col("call_turn").isNotNull()).alias("linked"),
        F.coalesce("level", F.lit(0)).alias("level"), F.greatest("turn", "place").alias("place"), (F.size(errors) == 0).alias("valid"), F.concat_ws(",", F.array_sort(F.array_distinct(errors))).alias("errors"), "json", "json_sha256",
    )


def sort_calls(rows: list[tuple]) -> list[tuple]:
    """(call_id, level, place) in Kahn's order of the calls that wait for none that can't be placed.

    rows: (call_id, call_turn, turn of its result or None, what it needs). Levels rise by two, a result lying between.
    """
    turn = {c: (t, r) for c, t, r, _ in rows}
    waits = {c: {n for n in needs if n in turn} for c, _, _, needs in rows}
    wanted: dict[str, list[str]] = {}
    for c, needs in waits.items():
        for n in needs:
            wanted.setdefault(n, []).append(c)
    open_ = {c: len(needs) for c, needs in waits.items()}
    place = {c: t for c, t, _, _ in rows}
    free, level, out = [c for c, n in open_.items() if not n], 0, []
    while free:
        after = []
        for c in free:
            out.append((c, level, place[c]))
            late = max(x for x in (place[c], turn[c][1]) if x is not None) if place[c] is not None or turn[c][1] is not None else None
            for d in wanted.get(c, ()):
                if late is not None and (place[d] is None or late > place[d]):
                    place[d] = late
                open_[d] -= 1
                if not open_[d]:
                    after.append(d)
        free, level = after, level + 2
    return out


def levels(linked: DataFrame, skeleton: int = 20_000) -> DataFrame:
    """(conv, call_id, kind, call_turn, level, place) of calls and results; level is null for calls that can't be placed. place is the latest turn that what stands before has."""
    named = linked.filter("call_id is not null and conv is not null")
    calls = cut(named.filter("kind = 'call'").groupBy("conv", "call_id").agg(F.min("turn").alias("call_turn")))
    results = named.filter("kind = 'result'").groupBy("conv", "call_id").agg(F.max("turn").alias("result_turn"))
    known = calls.select("conv", F.col("call_id").alias("need"))
    # What no call in the conversation answers is no hindrance.
    needs = cut(named.filter("kind = 'call'").select("conv", "call_id", F.explode("depends").alias("need")).distinct().join(known, ["conv", "need"], "left_semi"))
    tangled = needs.groupBy("conv").agg(F.count("*").alias("pairs"))
    small, large = tangled.filter(F.col("pairs") <= skeleton).select("conv"), cut(tangled.filter(F.col("pairs") > skeleton).select("conv"))
    # Calls that neither need nor are needed stand at their turn.
    ends = needs.select("conv", "call_id").unionByName(needs.select("conv", F.col("need").alias("call_id"))).distinct()
    done = calls.join(ends, ["conv", "call_id"], "left_anti").select("conv", "call_id", "call_turn", F.lit(0).alias("level"), F.col("call_turn").alias("place"))
    lists = needs.join(small, "conv", "left_semi").groupBy("conv", "call_id").agg(F.collect_list("need").alias("depends"))
    skeletons = calls.join(ends.join(small, "conv", "left_semi"), ["conv", "call_id"], "left_semi").join(results, ["conv", "call_id"], "left").join(lists, ["conv", "call_id"], "left")
    skeletons = skeletons.select("conv", F.struct("call_id", "call_turn", "result_turn", F.coalesce("depends", F.array().cast("array<string>")).alias("depends")).alias("call"))
    gathered = skeletons.groupBy("conv").agg(F.collect_list("call").alias("calls"))  # at most 2 * skeleton calls, for ends of pairs only

    def make():
        def sort(found):
            turns = {c["call_id"]: c["call_turn"] for c in found}
            rows = sorted(((c["call_id"], c["call_turn"], c["result_turn"], c["depends"]) for c in found), key=lambda r: r[0])
            return [{"call_id": c, "call_turn": turns[c], "level": level, "place": place} for c, level, place in sort_calls(rows)]

        return lambda lists: (list(map(sort, lists)),)

    sorted_ = per_row(gathered, ["conv"], ["calls"], "calls array<struct<call_id: string, call_turn: long, level: int, place: long>>", make).select("conv", F.inline("calls"))
    done = done.unionByName(sorted_)
    if not large.isEmpty():
        done = done.unionByName(_levels_by_rounds(calls.join(ends, ["conv", "call_id"], "left_semi").join(large, "conv", "left_semi"), needs.join(large, "conv", "left_semi"), results))
    done = cut(done)
    of_call = done.select("conv", "call_id", F.lit("call").alias("kind"), "call_turn", "level", "place")
    answered = results.join(calls.select("conv", "call_id", "call_turn"), ["conv", "call_id"]).join(done.select("conv", "call_id", "level", "place"), ["conv", "call_id"], "left")
    of_result = answered.select("conv", "call_id", F.lit("result").alias("kind"), "call_turn", (F.coalesce("level", F.lit(0)) + 1).alias("level"), F.coalesce("place", "call_turn").alias("place"))
    stuck = calls.join(done, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit("call").alias("kind"), "call_turn", F.lit(None).cast("int").alias("level"), F.col("call_turn").alias("place"))
    return of_call.unionByName(of_result).unionByName(stuck)


def _levels_by_rounds(calls: DataFrame, needs: DataFrame, results: DataFrame) -> DataFrame:
    """(conv, call_id, call_turn, level, place): Kahn's order by joins, a level a round."""
    calls, needs = cut(calls), cut(needs)
    new = done = cut(calls.join(needs, ["conv", "call_id"], "left_anti").select("conv", "call_id", "call_turn", F.lit(0).alias("level"), F.col("call_turn").alias("place")))
    step = 0
    while not new.isEmpty():
        step += 2
        late = done.join(results, ["conv", "call_id"], "left").select("conv", F.col("call_id").alias("need"), F.greatest("place", "result_turn").alias("after"), F.lit(True).alias("there"))
        waiting = needs.join(done, ["conv", "call_id"], "left_anti")
        ready = waiting.join(late, ["conv", "need"], "left").groupBy("conv", "call_id").agg(F.max("after").alias("after"), F.count_if(F.col("there").isNull()).alias("open")).filter("open = 0")
        new = cut(ready.join(calls, ["conv", "call_id"]).select("conv", "call_id", "call_turn", F.lit(step).alias("level"), F.greatest("call_turn", "after").alias("place")))
        done = cut(done.unionByName(new))
    return done
