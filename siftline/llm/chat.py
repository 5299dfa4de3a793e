"""Chat formatting with linked tool calls.

A turn may hold tool calls, as a JSON object ``{"content": ..., "tool_calls":
[{"id", "name", "arguments"}, ...]}``, or a result, as ``{"tool_call_id": ...,
"content": ...}``, or declare tools, as ``{"content": ..., "tools": [{"name",
"parameters"}, ...]}`` with schemas of arguments, which hold for its conversation;
any other text is plain content.  Calls and results of a
conversation are hash-joined by identifier, calls are ordered topologically by
the results their arguments refer to (strings like ``"$id"``), arguments are
validated against the tools' schemas, and each message is serialised as
canonical JSON: keys sorted, no spaces, characters unescaped.

Turns without calls or results never leave their task.  Levels of calls grow by
joins, so no conversation is gathered into one task.

Defined results
    null text            null content; null role: an empty string
    empty or very long   serialised whole
    JSON that isn't      plain content: with NaN, infinite numbers, halves of surrogate
    well formed          pairs, or more than MOST_DEPTH levels; likewise arguments given
                         as text stay text
    null conv_id         its calls link to nothing
    null or missing id   names nothing: a call with it has no result, a result with it answers
                         no call and is an orphan
    schemas              a keyword that isn't checked is an error when the job begins; an
                         argument that refers to a call stands for its result, so it breaks
                         a schema only where the conversation has no such call
    declared tools       come before given ones of their name; of several of a name in one
                         conversation the first (turn, schema) holds; with a schema that can't be
                         checked the turn is plain content; those of a null conv_id hold for nothing
    repeated rows, ties  a repeated turn is a message of its own; of several results
                         of one call the first (turn, text) is linked; a repeated
                         call identifier is a call of its own with the same result
    cyclic references    the calls have no level and come last; ``n_cyclic`` counts them
    empty table          empty result
    clashing columns     only the four columns named are read
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import materialise, tidy
from siftline.session import ship

_PARSED = "conv_id long, turn long, role string, text string, kind string, calls array<struct<seq:int,id:string,name:string,arguments:string,refs:array<string>,errors:array<string>,late:array<struct<ref:string,error:string>>>>, answers string, content string, tools array<struct<name:string,schema:string>>"
_TOOLS = pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())]))


#: Levels of nesting that are read; deeper JSON is plain content.
MOST_DEPTH = 256


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def read_json(text: str):
    """The value of well-formed JSON of bounded depth; any other raises ValueError."""
    depth, inside, escaped = 0, False, False
    if text.count("[") + text.count("{") > MOST_DEPTH:
        for ch in text:
            if inside:
                inside, escaped = escaped or ch != '"', ch == "\\" and not escaped
            elif ch == '"':
                inside = True
            elif ch in "[{":
                depth += 1
                if depth > MOST_DEPTH:
                    raise ValueError("nested too deeply")
            elif ch in "]}":
                depth -= 1
    value = json.loads(text)
    canonical(value).encode()  # neither NaN nor half a surrogate pair
    return value


def references(value) -> Iterator[str]:
    """Identifiers of calls that a value refers to."""
    if isinstance(value, str):
        if len(value) > 1 and value[0] == "$":
            yield value[1:]
    elif isinstance(value, dict):
        for v in value.values():
            yield from references(v)
    elif isinstance(value, list):
        for v in value:
            yield from references(v)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _KINDS.get(kind, object))


# Keywords of schemas that are checked, and those that only describe.
CHECKED = (
    "type enum const required properties additionalProperties items minimum maximum exclusiveMinimum exclusiveMaximum multipleOf "
    "minLength maxLength pattern minItems maxItems uniqueItems minProperties maxProperties anyOf allOf oneOf not"
).split()
DESCRIBING = "title description default examples format deprecated $schema $id $comment".split()


def check_schema(schema, at: str = "") -> None:
    """Raises ValueError for a schema with keywords that arguments can't be checked against."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at or '/'}: a schema is an object, true or false")
    unknown = sorted(set(schema) - {*CHECKED, *DESCRIBING})
    if unknown:
        raise ValueError(f"{at or '/'}: unknown keyword '{unknown[0]}'")
    for k, s in schema.get("properties", {}).items():
        check_schema(s, f"{at}/{k}")
    for k in ("items", "additionalProperties", "not"):
        if k in schema:
            check_schema(schema[k], f"{at}/{k}")
    for k in ("anyOf", "allOf", "oneOf"):
        for i, s in enumerate(schema.get(k, [])):
            check_schema(s, f"{at}/{k}/{i}")


#: (keyword, kind of value, whether a value breaks it, what is said).
_BOUNDS = (
    ("minimum", "number", lambda v, x: v < x, "below minimum"),
    ("maximum", "number", lambda v, x: v > x, "above maximum"),
    ("exclusiveMinimum", "number", lambda v, x: v <= x, "not above exclusiveMinimum"),
    ("exclusiveMaximum", "number", lambda v, x: v >= x, "not below exclusiveMaximum"),
    ("multipleOf", "number", lambda v, x: Fraction(str(v)) % Fraction(str(x)) != 0, "not multipleOf"),
    ("minLength", "string", lambda v, x: len(v) < x, "shorter than minLength"),
    ("maxLength", "string", lambda v, x: len(v) > x, "longer than maxLength"),
    ("pattern", "string", lambda v, x: re.search(x, v) is None, "doesn't match pattern"),
    ("minItems", "array", lambda v, x: len(v) < x, "fewer than minItems"),
    ("maxItems", "array", lambda v, x: len(v) > x, "more than maxItems"),
    ("uniqueItems", "array", lambda v, x: x and len({canonical(i) for i in v}) < len(v), "items not unique"),
    ("minProperties", "object", lambda v, x: len(v) < x, "fewer than minProperties"),
    ("maxProperties", "object", lambda v, x: len(v) > x, "more than maxProperties"),
)


def violations(value, schema, at: str = "") -> list[tuple[str, str | None]]:
    """Ways in which a value breaks a JSON schema, each with the identifier that the value refers to, if that is why.

    A string ``"$id"`` stands for the result of a call, so what it breaks counts only where there is no such call.
    """
    here, ref = at or "/", value[1:] if isinstance(value, str) and len(value) > 1 and value[0] == "$" else None
    out: list[tuple[str, str | None]] = []
    say = lambda text: out.append((f"{here}: {text}", ref))
    if isinstance(schema, bool):
        return [] if schema else [(f"{here}: not allowed", ref)]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        say(f"not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}")
        return out
    same = canonical(value)
    if "enum" in schema and same not in map(canonical, schema["enum"]):
        say("not in enum")
    if "const" in schema and same != canonical(schema["const"]):
        say("not const")
    for keyword, kind, broken, text in _BOUNDS:
        if keyword in schema and _is(value, kind) and broken(value, schema[keyword]):
            say(text)
    if isinstance(value, dict):
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [(f"{at}/{k}: missing", None) for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}/{k}")
            elif other is False:
                out.append((f"{at}/{k}: not allowed", None))
            else:
                out += violations(value[k], other, f"{at}/{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}/{i}")
    for s in schema.get("allOf", []):
        out += violations(value, s, at)
    for keyword, fits in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if keyword in schema and not fits(sum(not violations(value, s, at) for s in schema[keyword])):
            say(f"doesn't fit {keyword}")
    if "not" in schema and not violations(value, schema["not"], at):
        say("fits what it must not")
    return out


def _identifier(value) -> str | None:
    """An identifier as text; null names nothing."""
    return None if value is None else str(value)


#: What a schema of wrong values raises; it comes from the data, so it ends as an error of the call.
_UNFIT = (ValueError, TypeError, AttributeError, ArithmeticError, re.error)


def declared(value) -> list[dict] | None:
    """The tools that a turn declares, with their schemas as text; None if it declares none that can be checked."""
    tools = value.get("tools") if isinstance(value, dict) else None
    if not isinstance(tools, list) or not tools or not all(isinstance(t, dict) and isinstance(t.get("name"), str) for t in tools):
        return None
    try:
        for t in tools:
            schema = t.get("parameters", True)
            check_schema(schema)
            violations({}, schema)
    except (*_UNFIT, RecursionError):
        return None
    return [{"name": t["name"], "schema": canonical(t.get("parameters", True))} for t in tools]


def parse(text: str | None, tools: dict[str, dict]) -> tuple[str, list, str | None, str | None, list]:
    """(kind, calls, identifier answered, content, tools declared) of a turn."""
    if text and text.lstrip()[:1] == "{":
        try:
            value = read_json(text)
        except ValueError:
            value = None
        if isinstance(value, dict) and isinstance(value.get("tool_calls"), list) and all(isinstance(c, dict) for c in value["tool_calls"]):
            calls = []
            for seq, c in enumerate(value["tool_calls"]):
                arguments = c.get("arguments", {})
                if isinstance(arguments, str):
                    try:
                        arguments = read_json(arguments)
                    except ValueError:
                        pass
                name = str(c.get("name", ""))
                found = violations(arguments, tools[name]) if name in tools else [("unknown tool", None)] if tools else []
                late = [{"ref": ref, "error": e} for e, ref in found if ref is not None]
                calls.append({"seq": seq, "id": _identifier(c.get("id")), "name": name, "arguments": canonical(arguments), "refs": sorted(set(references(arguments))), "errors": [e for e, ref in found if ref is None], "late": late})
            content = value.get("content")
            return "calls", calls, None, content if content is None or isinstance(content, str) else canonical(content), []
        if isinstance(value, dict) and "tool_call_id" in value:
            content = value.get("content")
            return "result", [], _identifier(value["tool_call_id"]), content if content is None or isinstance(content, str) else canonical(content), []
        own = declared(value)
        if own:
            content = value.get("content")
            return "tools", [], None, content if content is None or isinstance(content, str) else canonical(content), own
    return "plain", [], None, text, []


def judged(calls: DataFrame, special: DataFrame) -> DataFrame:
    """``calls`` with what breaks the schemas that their own conversations declare, each checked in the task that its row is in."""
    tools = special.filter("kind = 'tools' AND conv_id IS NOT NULL").select("conv_id", "turn", F.explode("tools").alias("t"))
    first = tools.groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min(F.struct("turn", "t.schema")).alias("m")).select("conv_id", "name", "m.schema")
    if first.isEmpty():
        return calls
    having = first.select("conv_id").distinct().withColumn("having", F.lit(True))
    met = calls.join(first, ["conv_id", "name"], "left").join(having, "conv_id", "left")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["schema"] is not None:
                    try:
                        found = violations(json.loads(r["arguments"]), json.loads(r["schema"]))
                    except (*_UNFIT, RecursionError):
                        found = [("/: schema doesn't apply", None)]
                    r["errors"] = [e for e, ref in found if ref is None]
                    r["late"] = [{"ref": ref, "error": e} for e, ref in found if ref is not None]
                elif r["having"] and not r["given"]:
                    r["errors"] = ["unknown tool"]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in batch.schema], schema=batch.schema)

    return materialise(met.mapInArrow(tidy(check), met.schema).select(*calls.columns), "judged")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 for calls that refer to no call before; else one more than the highest referred to.

    Calls on a cycle, or behind one, have no row.
    """
    known = calls.select("conv_id", "id").distinct()
    edges = calls.select("conv_id", "id", F.explode("refs").alias("ref")).distinct()
    edges = edges.join(known.withColumnRenamed("id", "ref"), ["conv_id", "ref"], "left_semi")
    waiting = materialise(edges, "references")
    frontier = materialise(known.join(waiting, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    done, level = [frontier.scratch_path], 0
    while not waiting.isEmpty():
        # A reference is settled by the round before; a call is ready when none is left.
        left = materialise(waiting.join(frontier.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_anti"), "references")
        level += 1
        ready = waiting.select("conv_id", "id").distinct().join(left.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
        frontier, waiting = materialise(ready.withColumn("level", F.lit(level)), "levels"), left
        if frontier.isEmpty():
            break
        done.append(frontier.scratch_path)
    return calls.sparkSession.read.schema(frontier.schema).parquet(*done)


def format_chat(turns: DataFrame, tools: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, n_calls, n_linked, n_invalid, n_cyclic, orphan, message.

    ``message`` is canonical JSON.  ``orphan``: the turn is a result that no call asked for.
    ``tools``: a schema of the arguments for each tool name, beside what conversations declare.
    """
    tools = tools or {}
    for name, schema in tools.items():
        check_schema(schema, name)
    ship(turns.sparkSession)
    named = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").alias("role"),
        F.col(f"`{text_col}`").alias("text"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = pa.struct([("seq", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string())), ("errors", pa.list_(pa.string())), ("late", pa.list_(pa.struct([("ref", pa.string()), ("error", pa.string())])))])
        for batch in batches:
            rows = [parse(t, tools) for t in batch.column(3).to_pylist()]
            kinds, calls, answers, content, own = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(kinds, pa.string()), pa.array(calls, pa.list_(call)), pa.array(answers, pa.string()), pa.array(content, pa.string()), pa.array(own, _TOOLS)],
                ["conv_id", "turn", "role", "text", "kind", "calls", "answers", "content", "tools"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages, counts = [], []
            for r in batch.to_pylist():
                message = {"content": r["content"], "role": r["role"] or ""}
                calls = sorted(r["linked"] or [], key=lambda c: (c["level"] is None, c["level"], c["seq"]))
                if r["kind"] == "calls":
                    message["tool_calls"] = [
                        {"arguments": json.loads(c["arguments"]), "id": c["id"], "name": c["name"]} | ({"result": c["result"]} if c["has_result"] else {}) | ({"errors": c["errors"]} if c["errors"] else {})
                        for c in calls
                    ]
                if r["kind"] == "tools":
                    message["tools"] = [{"name": t["name"], "parameters": json.loads(t["schema"])} for t in r["tools"]]
                if r["kind"] == "result":
                    message["tool_call_id"] = r["answers"]
                messages.append(canonical(message))
                counts.append([len(calls), sum(c["has_result"] for c in calls), sum(bool(c["errors"]) for c in calls), sum(c["level"] is None for c in calls)])
            columns = list(zip(*counts, strict=True)) if counts else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, pa.int64()) for c in columns], batch.column(batch.schema.get_field_index("orphan")), pa.array(messages, pa.string())],
                ["conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "n_cyclic", "orphan", "message"],
            )

    parsed = named.mapInArrow(tidy(read), _PARSED)
    special = materialise(parsed.filter("kind != 'plain'").withColumn("row", F.monotonically_increasing_id()), "special")
    linked_type = "array<struct<seq:int,id:string,name:string,arguments:string,errors:array<string>,level:int,has_result:boolean,result:string>>"
    schema = "conv_id long, turn long, role string, n_calls long, n_linked long, n_invalid long, n_cyclic long, orphan boolean, message string"
    wanted = ["conv_id", "turn", "role", "kind", "answers", "content", "tools"]
    plain = parsed.filter("kind = 'plain'").select(*wanted, F.lit(None).cast(linked_type).alias("linked"), F.lit(False).alias("orphan"))
    if special.isEmpty():
        return plain.mapInArrow(tidy(write), schema)
    calls = special.filter("kind = 'calls'").select("row", "conv_id", F.explode("calls").alias("c")).select("row", "conv_id", "c.*", F.col("c.name").isin(list(tools)).alias("given"))
    calls = judged(calls, special)
    results = special.filter("kind = 'result' AND answers IS NOT NULL").groupBy("conv_id", F.col("answers").alias("id")).agg(F.min(F.struct("turn", "text", "content")).alias("r"))
    results = results.select("conv_id", "id", F.lit(True).alias("has_result"), F.col("r.content").alias("result"))
    # A call without identifier is named by its place: nothing can refer to it, but it has a level.
    placed = calls.withColumn("id", F.coalesce("id", F.concat(F.lit("\0"), "row", F.lit(":"), "seq")))
    level = levels(placed.select("conv_id", "id", "refs"))
    broken = calls.select("row", "seq", "conv_id", F.explode("late").alias("l")).select("row", "seq", "conv_id", F.col("l.ref").alias("id"), "l.error")
    broken = broken.join(calls.select("conv_id", "id"), ["conv_id", "id"], "left_anti").groupBy("row", "seq").agg(F.sort_array(F.collect_list("error")).alias("more"))
    joined = placed.join(level, ["conv_id", "id"], "left").select("row", "seq", "level").join(calls, ["row", "seq"]).join(results, ["conv_id", "id"], "left").join(broken, ["row", "seq"], "left")
    errors = F.concat("errors", F.coalesce("more", F.array().cast("array<string>"))).alias("errors")
    call = F.struct("seq", "id", "name", "arguments", errors, "level", F.coalesce("has_result", F.lit(False)).alias("has_result"), "result")
    by_row = joined.groupBy("row").agg(F.collect_list(call).alias("linked"))
    asked = calls.filter("id IS NOT NULL").select("conv_id", F.col("id").alias("answers")).distinct().withColumn("asked", F.lit(True))
    full = special.join(by_row, "row", "left").join(asked, ["conv_id", "answers"], "left")
    full = full.select(*wanted, F.col("linked").cast(linked_type).alias("linked"), ((F.col("kind") == "result") & F.col("asked").isNull()).alias("orphan"))
    return plain.unionByName(full).mapInArrow(tidy(write), schema)
