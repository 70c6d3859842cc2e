"""Chat formatting with tool calls, in DataFrame functions only.

An assistant turn whose text is a JSON object with ``tool_calls``, a list, calls
tools: each entry has id, name and arguments, in itself or in its ``function``;
arguments are an object or a JSON text of one. A tool turn whose text is a JSON
object with ``tool_call_id`` is a result. Results are hash-joined to calls by
conversation and identifier, arguments are checked against the tools' JSON
schemas, and each turn becomes one message in canonical JSON: keys in order, no
blanks, numbers in one form. Entries that are no calls, calls without an
identifier and fields beside the known ones stay in the message.

Turns are ordered so that every call stands before its results: a result that
comes too early moves to just behind its call. Positions are prefix sums over
slices of 64 turns and groups of slices, so that no task orders a whole conversation.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tools and the JSON schemas of their arguments; a name stands for a schema of that type.
TOOLS = {
    "search": {"required": ["query"], "properties": {"query": "string", "limit": "integer"}},
    "calculate": {"required": ["expression"], "properties": {"expression": "string", "precision": "integer"}},
    "fetch": {"required": ["url"], "properties": {"url": "string", "headers": "object", "follow": "boolean"}},
    "run": {"required": ["code"], "properties": {"code": "string", "args": "array", "timeout": "number"}},
}
#: Bits of a turn within its slice, and of a slice within its group; turns from which a slice is dealt into parts.
SLICE_BITS, GROUP_BITS, HOT_SLICE = 6, 12, 10_000
LAST = (1 << 63) - 1
MAP = "map<string,variant>"


def field(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def of_type(value: Column, wanted: str) -> Column:
    """Whether a value has a JSON schema's type; whole numbers are integers however they are written."""
    kind, number = kind_of(value), field(value, "$", "double")
    real = kind == "DOUBLE"
    if wanted == "integer":
        return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$") | (real & (F.floor(number).cast("double") == number))
    if wanted == "number":
        return (kind == "BIGINT") | real | kind.startswith("DECIMAL")
    names = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    if wanted in names:
        return kind == names[wanted]
    if wanted in ("array", "object"):
        return kind.startswith(wanted.upper())
    raise ValueError(f"no type {wanted!r} in JSON schemas")


def holds(value: Column, schema: dict | bool | str) -> Column:
    """Whether a variant fulfils a JSON schema: type, enum, const, bounds, lengths, pattern, properties, items, anyOf, allOf, oneOf and not."""
    if isinstance(schema, bool):
        return F.lit(schema)
    if isinstance(schema, str):
        schema = {"type": schema}
    tests = []
    own = F.to_json(value)
    same = lambda x: own == F.to_json(F.parse_json(F.lit(json.dumps(x))))
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        tests.append(some([of_type(value, k) for k in kinds]))
    if "enum" in schema:
        tests.append(some([same(x) for x in schema["enum"]]))
    if "const" in schema:
        tests.append(same(schema["const"]))
    number, text = field(value, "$", "double"), field(value, "$", "string")
    is_number, is_text = of_type(value, "number"), of_type(value, "string")
    for name, test in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n), ("exclusiveMinimum", lambda n: number > n), ("exclusiveMaximum", lambda n: number < n)):
        if name in schema:
            tests.append(~is_number | test(F.lit(float(schema[name]))))
    for name, test in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n), ("pattern", lambda p: text.rlike(p))):
        if name in schema:
            tests.append(~is_text | test(schema[name]))
    named, is_object = field(value, "$", MAP), of_type(value, "object")
    properties = schema.get("properties", {})
    for name in schema.get("required", []):
        tests.append(~is_object | F.map_contains_key(named, name))
    for name, part in properties.items():
        tests.append(~is_object | ~F.map_contains_key(named, name) | holds(F.element_at(named, name), part))
    if schema.get("additionalProperties", True) is not True:
        rest = F.map_filter(named, lambda k, _: ~k.isin(list(properties)) if properties else F.lit(True))
        tests.append(~is_object | F.forall(F.map_values(rest), lambda x: holds(x, schema["additionalProperties"])))
    listed, is_array = field(value, "$", "array<variant>"), of_type(value, "array")
    if "items" in schema:
        tests.append(~is_array | F.forall(listed, lambda x: holds(x, schema["items"])))
    for name, test in (("minItems", lambda n: F.size(listed) >= n), ("maxItems", lambda n: F.size(listed) <= n)):
        if name in schema:
            tests.append(~is_array | test(schema[name]))
    for part in schema.get("allOf", []):
        tests.append(holds(value, part))
    if "anyOf" in schema:
        tests.append(some([holds(value, part) for part in schema["anyOf"]]))
    if "oneOf" in schema:
        tests.append(sum((holds(value, part).cast("int") for part in schema["oneOf"]), F.lit(0)) == 1)
    if "not" in schema:
        tests.append(~holds(value, schema["not"]))
    out = F.lit(True)
    for test in tests:
        out = out & F.coalesce(test, F.lit(False))
    return out


def some(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def valid(name: Column, arguments: Column, tools: dict) -> Column:
    """Whether the tool is known, and the arguments are an object that fulfils its schema."""
    out = None
    for tool, schema in sorted(tools.items()):
        test = F.coalesce(of_type(arguments, "object"), F.lit(False)) & holds(arguments, schema)
        out = F.when(name == tool, test) if out is None else out.when(name == tool, test)
    return F.lit(False) if out is None else F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def quoted(text: Column) -> Column:
    """A JSON string; null for a null text."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def opened(value: Column) -> Column:
    """A JSON text of an object or array as what it stands for, any other value as it is."""
    text = F.when(kind_of(value) == "STRING", field(value, "$", "string"))
    inner = F.try_parse_json(F.when(F.ltrim(text).rlike(r"^[\[{]"), text))
    return F.coalesce(inner, value)


def object_of(known: list[tuple[str, Column]], rest: Column) -> Column:
    """Canonical JSON of known fields (JSON texts) and a map of others."""
    parts = F.array(*[F.concat(F.lit(json.dumps(name) + ":"), F.coalesce(value, F.lit("null"))) for name, value in known])
    others = F.transform(F.map_entries(rest), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.to_json(e["value"])))
    whole = F.concat(F.lit("{"), F.array_join(F.concat(parts, F.coalesce(others, F.array().cast("array<string>"))), ","), F.lit("}"))
    return F.coalesce(F.to_json(F.try_parse_json(whole)), whole)


def without(named: Column, *names: str) -> Column:
    return F.map_filter(named, lambda k, _: ~k.isin(*names))


def call_of(entry: Column) -> Column:
    """A call's id, name and arguments; its canonical JSON."""
    name = F.coalesce(field(entry, "$.function.name", "string"), field(entry, "$.name", "string"))
    arguments = opened(F.coalesce(field(entry, "$.function.arguments"), field(entry, "$.arguments")))
    id_ = field(entry, "$.id", "string")
    kind = kind_of(entry)
    inner = without(field(entry, "$.function", MAP), "name", "arguments")
    rest = F.map_filter(field(entry, "$", MAP), lambda k, v: ~k.isin("id", "name", "arguments", "function") & ~((k == "type") & (F.to_json(v) == '"function"')))
    known = [("arguments", F.to_json(arguments)), ("id", quoted(id_)), ("name", quoted(name))]
    plain = object_of(known, rest)
    more = object_of([*known, ("function", object_of([], inner))], rest)
    text = F.when(~kind.startswith("OBJECT"), F.to_json(entry)).when(F.size(inner) > 0, more).otherwise(plain)
    return F.struct(id_.alias("id"), name.alias("name"), arguments.alias("arguments"), text.alias("json"))


def format_turns(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """(conv_id, position, turn, role, n_calls, n_valid, linked, message) for each row.

    position counts a conversation's messages from 0 in their new order. n_calls
    and n_valid count a turn's calls and those whose arguments hold; linked is
    null but for results: whether the call is there. Ids that several calls have
    belong to the first. A null conv_id is a conversation of its own; a null turn
    comes last; a null role or text is an empty string; ties follow a hash of role
    and text, and repeated rows get positions of their own. Text that only
    resembles JSON is ordinary text. A very long text is taken whole; other columns
    are not read, whatever their names. An empty table gives an empty one.
    """
    tools = TOOLS if tools is None else tools
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.coalesce("turn", F.lit(LAST)).cast("long").alias("at"))
    told = (F.col("role") == "assistant") & F.col("text").contains('"tool_calls"') | (F.col("role") == "tool") & F.col("text").contains('"tool_call_id"')
    said = F.when(told & F.ltrim(F.col("text")).startswith("{"), F.try_parse_json("text"))
    rows = rows.withColumn("said", said)
    entries = F.when(F.col("role") == "assistant", field(F.col("said"), "$.tool_calls", "array<variant>"))
    rows = rows.withColumn("calls", F.transform(entries, call_of))
    rows = rows.withColumn("answers", F.when(F.col("role") == "tool", field(F.col("said"), "$.tool_call_id", "string")))
    # results: joined to the first call of their id
    calls = rows.where(F.size("calls") > 0).select("conv_id", "at", F.explode("calls.id").alias("call_id")).where("call_id is not null")
    calls = calls.groupBy(F.col("conv_id").alias("c"), "call_id").agg(F.min("at").alias("called"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("answers") == F.col("call_id"))
    results = rows.where("answers is not null").join(calls.hint("shuffle_hash"), same, "left").drop("c", "call_id")
    rows = rows.where("answers is null").withColumn("called", F.lit(None).cast("long")).unionByName(results)
    # positions: rows of a part of a slice in order, behind the parts, slices and groups before
    rows = rows.withColumn("anchor", F.greatest("at", F.coalesce("called", "at"))).withColumn("late", F.coalesce(F.col("called") >= F.col("at"), F.lit(False)))
    rows = rows.withColumn("slice", F.shiftright("anchor", SLICE_BITS)).withColumn("tie", F.xxhash64("role", "text"))
    hot = rows.groupBy(F.col("conv_id").alias("c"), F.col("slice").alias("s")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_SLICE).select("c", "s", F.lit(True).alias("hot"))
    rows = rows.join(hot, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")), "left").drop("c", "s")
    place = F.col("anchor").bitwiseAND(F.lit((1 << SLICE_BITS) - 1)) * 8192
    part = F.when(F.col("late"), place + 4096).otherwise(place + F.shiftright("tie", 52) + 2048)
    rows = rows.withColumn("part", F.when(F.col("hot"), part).otherwise(F.lit(0)).cast("long"))
    parts = rows.groupBy("conv_id", F.shiftright("slice", GROUP_BITS).alias("wide"), "slice", "part").agg(F.count("*").alias("n"))
    wide = parts.groupBy(F.col("conv_id").alias("c"), F.col("wide").alias("w")).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("c").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.select("c", "w", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("front"))
    before = Window.partitionBy("conv_id", "wide").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.join(wide, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("wide") == F.col("w")))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), F.col("part").alias("p"), (F.col("front") + F.col("within")).alias("ahead"))
    own = Window.partitionBy("conv_id", "slice", "part").orderBy("anchor", "late", "at", "tie", "text")
    rows = rows.withColumn("own", F.row_number().over(own) - 1)
    rows = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")) & (F.col("part") == F.col("p")))
    # messages
    content = opened(field(F.col("said"), "$.content"))
    shown = F.when(kind_of(content) == "VOID", F.lit('""')).otherwise(F.coalesce(F.to_json(content), F.lit('""')))
    listed = F.concat(F.lit("["), F.array_join(F.col("calls.json"), ","), F.lit("]"))
    fields = field(F.col("said"), "$", MAP)
    plain = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))
    calling = object_of([("content", shown), ("role", F.lit('"assistant"')), ("tool_calls", listed)], without(fields, "content", "role", "tool_calls"))
    result = object_of([("content", shown), ("role", F.lit('"tool"')), ("tool_call_id", quoted(F.col("answers")))], without(fields, "content", "role", "tool_call_id"))
    return rows.select(
        "conv_id",
        (F.col("ahead") + F.col("own")).cast("long").alias("position"),
        "turn",
        "role",
        F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)).cast("long").alias("n_calls"),
        F.greatest(F.coalesce(F.size(F.filter("calls", lambda c: valid(c["name"], c["arguments"], tools))), F.lit(0)), F.lit(0)).cast("long").alias("n_valid"),
        F.when(F.col("answers").isNotNull(), F.col("called").isNotNull()).alias("linked"),
        F.when(F.size("calls") > 0, calling).when(F.col("answers").isNotNull(), result).otherwise(plain).alias("message"),
    )
