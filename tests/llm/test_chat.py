import json

from foldmill.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def call(*calls, content=""):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def formatted(spark, rows, **options):
    out = chat.format_turns(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted(out, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position))


def test_calls_and_results(spark):
    rows = [
        (1, 0, "user", "hé \"x\"\n\u0001"),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [1, {"y": None, "x": 2}]}})),
        (1, 3, "assistant", call(("a", "search", {"query": "q", "limit": 3}), ("b", "search", {"limit": "3", "query": "q"}), content="see")),
        (1, 4, "tool", json.dumps({"content": "plain", "tool_call_id": "b"})),
        (1, 5, "tool", json.dumps({"content": "lost", "tool_call_id": "zz"})),
        (1, 6, "assistant", "done"),
    ]
    got = formatted(spark, rows)
    assert [r.turn for r in got] == [0, 3, 2, 4, 5, 6] and [r.position for r in got] == list(range(6))
    assert [(r.n_calls, r.n_valid) for r in got] == [(0, 0), (2, 1), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert [r.linked for r in got] == [None, None, True, True, False, None]
    want = json.dumps({"content": rows[0][3], "role": "user"}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert json.loads(got[0].message) == json.loads(want) and got[0].message.startswith('{"content":"hé \\"x\\"\\n')
    assert got[1].message == (
        '{"content":"see","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search"},'
        '{"arguments":{"limit":"3","query":"q"},"id":"b","name":"search"}]}'
    )
    assert got[2].message == '{"content":{"b":[1,{"x":2,"y":null}],"z":1},"role":"tool","tool_call_id":"a"}'
    assert got[3].message == '{"content":"plain","role":"tool","tool_call_id":"b"}'


def test_schemas(spark):
    tools = {"t": {"required": ["s"], "properties": {"s": "string", "i": "integer", "n": "number", "b": "boolean", "a": "array", "o": "object"}}}
    good = [{"s": ""}, {"s": "x", "i": 1, "n": 1.5, "b": True, "a": [], "o": {}}, {"s": "x", "n": 2, "other": 1}]
    bad = [{}, {"s": 1}, {"s": "x", "i": 1.5}, {"s": "x", "b": "true"}, {"s": "x", "a": {}}, {"s": "x", "o": []}, [], "s", 3]
    rows = [(k, 0, "assistant", call(("i", "t", a))) for k, a in enumerate(good + bad)] + [(99, 0, "assistant", call(("i", "unknown", {"s": "x"})))]
    assert [r.n_valid for r in formatted(spark, rows, tools=tools)] == [1] * len(good) + [0] * (len(bad) + 1)


def test_json_schemas(spark):
    schema = {
        "type": "object",
        "required": ["n"],
        "additionalProperties": False,
        "properties": {
            "n": {"type": "integer", "minimum": 1, "maximum": 12345678901234567890},
            "e": {"enum": ["a", 2, {"k": [1]}]},
            "l": {"type": "array", "items": {"type": ["string", "null"], "maxLength": 3, "pattern": "^x"}, "minItems": 1},
            "o": {"type": "object", "properties": {"p": {"type": "object", "required": ["q"]}}, "additionalProperties": "number"},
            "u": {"anyOf": ["string", {"type": "number", "exclusiveMaximum": 0}]},
        },
    }
    good = [{"n": 3.0}, {"n": 12345678901234567890}, {"n": 1e3, "e": {"k": [1]}}, {"n": 1, "e": 2}, {"n": 1, "l": ["x", None]}, {"n": 2, "o": {"p": {"q": 0}, "z": 1.5}}, {"n": 1, "u": -0.5}]
    bad = [{}, {"n": 0}, {"n": 1.5}, {"n": "1"}, {"n": True}, {"n": 1, "x": 0}, {"n": 1, "e": "b"}, {"n": 1, "l": []}, {"n": 1, "l": ["y"]}, {"n": 1, "l": ["xxxx"]}, {"n": 1, "l": "x"}, {"n": 1, "o": {"p": {}}}, {"n": 1, "o": {"z": "1"}}, {"n": 1, "u": 0.5}, None, [], 3]
    rows = [(k, 0, "assistant", call(("i", "t", a))) for k, a in enumerate(good + bad)]
    assert [r.n_valid for r in formatted(spark, rows, tools={"t": schema})] == [1] * len(good) + [0] * len(bad)


def made(rng):
    """A conversation with calls in both formats, with and without ids, and results before and after them."""
    out, ids = [], []
    for turn in range(rng.randrange(3, 40)):
        pick = rng.random()
        if pick < 0.4:
            calls = []
            for _ in range(rng.randrange(1, 4)):
                arguments = rng.choice([{"query": "q", "limit": rng.choice([3, 3.0, 3.5, "3"])}, {"limit": 2}, {"query": "é \"", "z": [1, {"b": None, "a": 1.25}]}, [], "text"])
                one = {"id": f"c{rng.randrange(30)}"} if rng.random() < 0.8 else {}
                if one:
                    ids.append(one["id"])
                if rng.random() < 0.5:
                    one |= {"type": "function", "function": {"name": rng.choice(["search", "other"]), "arguments": json.dumps(arguments)}} | rng.choice([{}, {"index": 2}])
                else:
                    one |= {"name": rng.choice(["search", "other"]), "arguments": arguments, "weight": 0.5}
                calls.append(one)
            text = json.dumps({"tool_calls": calls, "content": rng.choice([None, "see"]), "model": "m"})
            out.append((turn, "assistant", text))
        elif pick < 0.7:
            out.append((turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(30)}", "content": rng.choice(["plain", {"z": 1, "a": [2]}, "[1, 2]"]), "name": "search"})))
        else:
            out.append((turn, rng.choice(["user", "assistant", "tool"]), rng.choice(["hello", "{\"a\": 1}", "{broken \"tool_calls\""])))
    return out


def expected(turns):
    """The messages of one conversation, plainly."""
    unpack = lambda x: json.loads(x) if isinstance(x, str) and x[:1] in "[{" and x[:1] else x
    first, rows = {}, []
    for turn, role, text in turns:
        try:
            said = json.loads(text)
        except ValueError:
            said = None
        said = said if isinstance(said, dict) else {}
        calls = said.get("tool_calls") if role == "assistant" else None
        for c in calls or []:
            if "id" in c:
                first.setdefault(c["id"], turn)
        rows.append((turn, role, text, said, calls, said.get("tool_call_id") if role == "tool" else None))
    out = []
    for turn, role, text, said, calls, answers in rows:
        called = first.get(answers)
        anchor = max(turn, called if called is not None else turn)
        listed, n_valid = [], 0
        for c in calls or []:
            f = c.get("function", {})
            arguments = unpack(f.get("arguments", c.get("arguments")))
            name = f.get("name", c.get("name"))
            rest = {k: v for k, v in c.items() if k not in ("id", "name", "arguments", "function") and (k, v) != ("type", "function")}
            listed.append(rest | {"id": c.get("id"), "name": name, "arguments": arguments})
            limit = arguments.get("limit", 1) if isinstance(arguments, dict) else None
            n_valid += name == "search" and isinstance(arguments, dict) and isinstance(arguments.get("query"), str) and isinstance(limit, (int, float)) and limit == int(limit)
        if calls:
            message = said | {"content": said["content"] or "", "role": "assistant", "tool_calls": listed}
        elif answers:
            message = said | {"content": unpack(said["content"]), "role": "tool"}
        else:
            message = {"content": text, "role": role}
        out.append(((anchor, anchor > turn or called == turn, turn), turn, len(calls or []), n_valid, None if answers is None else called is not None, message))
    return [(k, *r[1:]) for k, r in enumerate(sorted(out, key=lambda r: r[0]))]


def test_against_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(chat, "HOT_SLICE", 20)
    rng = random.Random(11)
    talks = [made(rng) for _ in range(120)]
    got = formatted(spark, [(c, *t) for c, turns in enumerate(talks) for t in turns])
    want = [(c, *r) for c, turns in enumerate(talks) for r in expected(turns)]
    assert [(r.conv_id, r.position, r.turn, r.n_calls, r.n_valid, r.linked, json.loads(r.message)) for r in got] == want
    assert all(r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in got if r.n_calls or r.linked is not None)
    assert sum(r[4] for r in want) > 100 and sum(r[5] is True for r in want) > 100


def test_calls_and_results_are_hash_joined(spark, small):
    plan = queries.op3_chat(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_hash" in plan


def test_many_turns_at_one_place(spark, monkeypatch):
    monkeypatch.setattr(chat, "HOT_SLICE", 50)
    rows = [(1, None if k % 2 else 7, "user", str(k)) for k in range(400)] + [(1, 3, "user", "first"), (2, 0, "user", "x")]
    got = formatted(spark, rows)
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(401))
    mine = [r.turn for r in got if r.conv_id == 1]
    assert mine == [3] + [7] * 200 + [None] * 200


def test_positions_of_long_conversations(spark):
    rows = [(k % 3, (k * 7919) % 1000, "user", str(k)) for k in range(900)]
    got = formatted(spark, rows)
    for c in range(3):
        mine = [r for r in got if r.conv_id == c]
        assert [r.position for r in mine] == list(range(300)) and [r.turn for r in mine] == sorted(r.turn for r in mine)


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (None, 1, "user", "a"), (1, None, "assistant", "{not json"), (1, 5, "assistant", '{"tool_calls":3}'), (1, 6, "tool", '{"tool_call_id":null,"content":1}'), (2, 0, "assistant", "x" * 200000), (3, 1, "assistant", call(("d", "run", {}))), (3, 2, "assistant", call(("d", "run", {}))), (3, 0, "tool", json.dumps({"tool_call_id": "d", "content": ""}))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "'x' as calls", "2 as slice")
    got = chat.format_turns(df).collect()
    assert len(got) == len(rows) and all(json.loads(r.message) for r in got)
    assert sorted(r.position for r in got if r.conv_id is None) == [0, 1, 2]
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 3), key=lambda r: r.position)] == [1, 0, 2]
    assert chat.format_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plain_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet").collect()
    place = {}
    for r in sorted(df, key=lambda r: (r.conv_id, r.turn)):
        place[r.conv_id, r.turn] = sum(1 for x in place if x[0] == r.conv_id), {"content": r.text, "role": r.role}
    got = queries.op3_chat(spark, small).collect()
    assert {(r.conv_id, r.turn): (r.position, json.loads(r.message)) for r in got} == place
