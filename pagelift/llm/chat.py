"""Chat formatting with tool-call linking.

Messages are parsed for tool calls and results; a hash join by conversation and identifier links each result to its
call; messages are put in topological order, a call before its results and otherwise by turn; arguments are validated
against the tools' schemas; and conversations are serialised as canonical JSON (keys sorted, no spaces, UTF-8).

A call stands in a message as JSON, {"tool_calls": [{"id", "name", "arguments"}, ...], "content": ...} as the whole
text or <tool_call>{"id", "name", "arguments"}</tool_call> within it; "function": {"name", "arguments"} is read, too,
and arguments may be JSON in a string. A result is a message of role tool or function with the text
{"tool_call_id", "content"}. All else is plain content.

Defined cases: of calls with one identifier in a conversation the first, by turn, is linked; others count as `duplicate`.
A result without its call keeps its place and is `unlinked`. A call without an identifier can't be linked. A null
conv_id makes a conversation of its own, a null turn comes first, a null role is `user`, null text is empty; ties are
ordered by role, then text, and repeated rows stay, each for itself. A conversation of more than PART_MESSAGES
messages is written in several parts, so that none is in one task whole. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import arrow_map, attach, materialize, small_batches, text_or_empty

#: Messages of a part of a conversation at most.
PART_MESSAGES = 500

# Order of roles of one turn, and the types of JSON schemas.
ROLES = ["system", "developer", "user", "assistant", "tool", "function"]
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)

MESSAGE = "conv_id long, turn long, role string, message string, call_ids array<string>, result_of string, errors array<string>"


def canonical(value: Any) -> str:
    """JSON with sorted keys and without spaces; halves of surrogate pairs become U+FFFD."""
    out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def loads(text: str) -> Any:
    """Strict JSON: no NaN, no infinity; a repeated key is an error."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("a key is repeated")
        return out

    def never(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    out = json.loads(text, object_pairs_hook=pairs, parse_constant=never)
    canonical(out)  # numbers beyond floats are caught here
    return out


def violations(value: Any, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema (type, enum, const, required, properties, additionalProperties, items, bounds)."""
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        number = isinstance(value, int | float) and not isinstance(value, bool)
        fits = lambda k: number and (k == "number" or float(value).is_integer()) if k in ("number", "integer") else isinstance(value, TYPES.get(k, ()))
        if not any(fits(k) for k in kinds):
            return [f"{path}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the values allowed")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the value required")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path}: out of range")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{path}: length out of range")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{path}: number of items out of range")
        for i, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(value[k], schema["additionalProperties"], f"{path}.{k}")
    return out


def _call(value: Any, schemas: dict[str, dict]) -> tuple[dict, list[str]]:
    """A call in its canonical shape, and what is wrong with it."""
    if not isinstance(value, dict):
        return {"arguments": value, "id": None, "name": None}, ["call: not an object"]
    inner = value.get("function") if isinstance(value.get("function"), dict) else value
    name, arguments, errors = inner.get("name"), inner.get("arguments", {}), []
    if isinstance(arguments, str):
        try:
            arguments = loads(arguments)
        except (ValueError, RecursionError):
            errors.append("arguments: not JSON")
    own = value.get("id")
    if not isinstance(own, str) or not own:
        own = None
        errors.append("call: no identifier")
    if not isinstance(name, str):
        name = None
        errors.append("call: no name")
    elif schemas and name not in schemas:
        errors.append(f"{name}: unknown tool")
    elif name in schemas and "arguments: not JSON" not in errors:
        errors += violations(arguments, schemas[name])
    return {"arguments": arguments, "id": own, "name": name}, errors


def parse(role: str, text: str, schemas: dict[str, dict]) -> tuple[dict, list[str], str | None, list[str]]:
    """Message, identifiers of its calls, identifier of the call that it answers, and errors."""
    whole: Any = None
    if text.lstrip()[:1] == "{":
        try:
            whole = loads(text)
        except (ValueError, RecursionError):
            whole = None
    if role in ("tool", "function") and isinstance(whole, dict) and isinstance(whole.get("tool_call_id"), str):
        return {"content": whole.get("content"), "role": role, "tool_call_id": whole["tool_call_id"]}, [], whole["tool_call_id"], []
    calls, content = [], text
    if isinstance(whole, dict) and isinstance(whole.get("tool_calls"), list):
        calls, content = whole["tool_calls"], whole.get("content")
    elif "<tool_call>" in text:
        bad = []
        for m in _CALL.finditer(text):
            try:
                calls.append(loads(m.group(1)))
            except (ValueError, RecursionError):
                bad.append("call: not JSON")
        if bad:  # the text stays as it is
            return {"content": text, "role": role}, [], None, bad
        content = _CALL.sub("", text).strip()
    if not calls:
        return {"content": content, "role": role}, [], None, []
    found = [_call(c, schemas) for c in calls]
    return {"content": content, "role": role, "tool_calls": [c for c, _ in found]}, [c["id"] for c, _ in found if c["id"]], None, [e for _, es in found for e in es]


def messages(rows: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """MESSAGE of each row of conv_id, turn, role and text."""
    schemas = schemas or {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        roles = [r or "user" for r in batch.column(2).to_pylist()]
        found = [parse(r, t, schemas) for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
        strings = pa.list_(pa.string())
        columns = [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array([canonical(m) for m, _, _, _ in found], pa.string()), pa.array([c for _, c, _, _ in found], strings), pa.array([r for _, _, r, _ in found], pa.string()), pa.array([e for *_, e in found], strings)]
        return pa.record_batch(columns, names=[x.split()[0] for x in MESSAGE.split(", ")])

    small_batches(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text_or_empty("text").alias("text"))
    return arrow_map(rows, MESSAGE, one, text=3)


def linked(found: DataFrame, total: int) -> DataFrame:
    """Messages with the turn of the call that they answer (call_turn) and order keys; total: how many there are."""
    keys = ["conv_", "call_id"]
    own = found.withColumn("conv_", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    calls = own.select("conv_", "turn", "message", F.explode(F.array_distinct("call_ids")).alias("call_id"))
    first = calls.groupBy(*keys).agg(F.min(F.struct("turn", F.xxhash64("message").alias("h"))).alias("first"))
    answers = own.filter("result_of is not null").groupBy("conv_", F.col("result_of").alias("call_id")).agg(F.count(F.lit(1)).alias("n_results"))
    calls_of = first.join(answers, keys).select(*keys, F.col("first.turn").alias("call_turn"), F.lit(True).alias("is_linked"), "n_results")
    results = own.filter("result_of is not null").withColumn("call_id", F.col("result_of"))
    results = attach(results, calls_of, keys, "n_results", total).drop("n_results", "call_id")
    others = own.filter("result_of is null").withColumns({"call_turn": F.lit(None).cast("long"), "is_linked": F.lit(None).cast("boolean")})
    out = results.unionByName(others)
    late = F.col("is_linked") & (F.coalesce("call_turn", F.lit(-(2**62))) >= F.coalesce("turn", F.lit(-(2**62))))
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return out.withColumns({
        "after": F.when(late, F.col("call_turn")).otherwise(F.col("turn")),
        "level": F.when(F.col("is_linked"), 1).otherwise(0),
        "role_rank": F.when(rank == 0, len(ROLES) + 1).otherwise(rank),
    })


def positions(rows: DataFrame) -> DataFrame:
    """rows with their position in the conversation. Ranges of conversations and order keys are dealt to partitions,
    whose counts are summed up first, so that a long conversation is in many of them."""
    order = ["conv_", "after", "level", "turn", "role_rank", "message"]
    dealt = rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    dealt = materialize(dealt, "chat-ranges")
    counts = dealt.groupBy("conv_", "range_").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_", "range_", (F.sum("n").over(Window.partitionBy("conv_").orderBy("range_")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range_", "conv_").orderBy(*order[1:]))
    return dealt.withColumn("within", within).join(before, ["conv_", "range_"]).withColumn("position", F.col("before") + F.col("within") - 1)


def format_conversations(rows: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, part, messages, calls, results, unlinked, invalid, conversation (canonical JSON) and errors (with their
    messages' positions) of each part, and duplicate: calls of the whole conversation with an identifier taken before."""
    found = materialize(messages(rows, schemas), "chat-messages")
    placed = positions(linked(found, found.count())).withColumn("part", F.expr(f"position div {PART_MESSAGES}"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = placed.groupBy("conv_id", "conv_", "part").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.size("call_ids")).cast("long").alias("calls"),
        count(F.col("result_of").isNotNull()).alias("results"),
        count(F.col("result_of").isNotNull() & F.col("is_linked").isNull()).alias("unlinked"),
        count(F.size("errors") > 0).alias("invalid"),
        F.array_sort(F.collect_list(F.struct("position", "message"))).alias("list_"),
        F.array_sort(F.flatten(F.collect_list(F.transform("errors", lambda e: F.struct("position", e.alias("error")))))).alias("errors_"),
    )
    calls = found.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv_"), F.explode("call_ids").alias("call_id"))
    again = calls.groupBy("conv_", "call_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("conv_").agg(F.sum(F.col("n") - 1).alias("duplicate"))
    out = out.join(again, "conv_", "left")
    body = F.array_join(F.transform("list_", lambda m: m["message"]), ",")
    return out.select("conv_id", "part", "messages", "calls", "results", "unlinked", "invalid", F.concat(F.lit('{"messages":['), body, F.lit("]}")).alias("conversation"), F.coalesce("duplicate", F.lit(0)).cast("long").alias("duplicate"), F.transform("errors_", lambda e: F.concat_ws(": ", e["position"].cast("string"), e["error"])).alias("errors"))
