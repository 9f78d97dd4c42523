import json

from plaudit.llm.chats import TURN_SCHEMAS, calls_of_turns, canonical, conforms, linked_calls

CALLS = "conv_id long, call_id string, name string, arguments string, needs array<string>, level string, node string"
RESULTS = "conv_id long, call_id string, content string, rank string"
SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}}


def call(conv, ident, arguments='{"x": 1}', needs=(), name="add"):
    return (conv, ident, name, arguments, None if needs is None else list(needs), "clash", "clash")


def test_links_order_and_states(spark):
    calls = [
        call(1, "c", needs=["b", "a"]), call(1, "b", '{"x": 2}', ["a"]), call(1, "a", needs=None),
        call(1, "p", needs=["q"]), call(1, "q", needs=["p"]), call(1, "behind", needs=["q"]),
        call(2, "a", '{"y": 1}'), call(2, "b", "not json"), call(2, "n", None), call(2, "t", name="other"), call(2, "z", name=None),
        call(2, "m", needs=["nowhere"]), call(2, "w"), call(2, "w"), call(2, "w", '{"x": 9}'), call(None, "a"), call(2, None),
    ]
    results = [(1, i, f"é {i}", "") for i in "abcpq"] + [(1, "a", "zz", ""), (2, "m", None, ""), (2, "gone", "r", ""), (None, "a", "r", ""), (3, "a", "r", "")]
    found = linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    state = {(r.conv_id, r.call_id): r.status for r in found}
    assert state == {
        **{(1, i): "ok" for i in "abc"}, **{(1, i): "cycle" for i in ("p", "q", "behind")},
        (2, "a"): "invalid", (2, "b"): "invalid", (2, "n"): "invalid", (2, "t"): "unknown_tool", (2, "z"): "unknown_tool",
        (2, "m"): "missing_need", (2, "w"): "no_result", (2, "gone"): "orphan", (3, "a"): "orphan",
    }
    one = {r.call_id: r for r in found if r.conv_id == 1}
    assert [one[i].level for i in "abc"] == [0, 1, 2] and [one[i].position for i in "abc"] == [0, 1, 2]
    for conv in (1, 2, 3):
        places = sorted(r.position for r in found if r.conv_id == conv)
        assert places == list(range(len(places)))
    assert one["b"].line == '{"arguments":{"x":2},"id":"b","name":"add","needs":["a"],"result":{"content":"é b"}}'
    assert json.loads(one["a"].line)["result"] == {"content": "zz"} or json.loads(one["a"].line)["result"] == {"content": "é a"}
    for r in found:
        assert r.line == canonical(json.loads(r.line))


def test_long_chains_meet_and_circle(spark):
    """A chain, two that meet and go on as one, and one that runs into a circle of three."""
    calls = [call(1, str(i), needs=[str(i - 1)] if i else []) for i in range(70)]
    calls += [call(2, f"a{i}", needs=[f"a{i - 1}"] if i else []) for i in range(9)] + [call(2, f"b{i}", needs=[f"b{i - 1}"] if i else []) for i in range(4)]
    calls += [call(2, "m", needs=["a8", "b3"])] + [call(2, f"c{i}", needs=[f"c{i - 1}" if i else "m"]) for i in range(5)]
    calls += [call(2, "d", needs=["c4", "b0", "m"]), call(2, "e", needs=["d"])]
    calls += [call(3, f"x{i}", needs=[f"x{(i + 1) % 3}"]) for i in range(3)] + [call(3, f"y{i}", needs=[f"y{i - 1}" if i else "x0"]) for i in range(6)]
    calls += [call(3, "self", needs=["self"]), call(3, "z", needs=["y2", "free"]), call(3, "free")]
    found = linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    level = {(r.conv_id, r.call_id): r.level for r in found}
    assert {i: level[1, str(i)] for i in range(70)} == {i: i for i in range(70)}
    assert level[2, "m"] == 9 and [level[2, f"c{i}"] for i in range(5)] == [10, 11, 12, 13, 14] and level[2, "d"] == 15 and level[2, "e"] == 16
    assert level[3, "free"] == 0 and all(v is None for (conv, i), v in level.items() if conv == 3 and i != "free")
    assert sorted(r.position for r in found if r.conv_id == 1) == [level[1, str(i)] for i in range(70)]


def test_turns_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, name string"
    turns = [(1, 0, "system", "s", ""), (1, 1, "user", "q", ""), (1, 2, "assistant", "r", ""), (1, 3, "user", "", ""), (2, 0, "user", None, ""), (None, 0, "user", "x", "")]
    found = linked_calls(*calls_of_turns(spark.createDataFrame(turns, schema)), TURN_SCHEMAS).collect()
    assert {r.call_id: r.status for r in found} == {"call-1-1": "ok", "call-1-3": "invalid", "call-2-0": "invalid"}
    astray = [(1, None, "assistant", t, "") for t in ("x", "x", "y", None)] + [(1, None, "user", "u", ""), (1, None, "user", "u", ""), (1, None, "system", "u", "")]
    found = linked_calls(*calls_of_turns(spark.createDataFrame(turns + astray, schema)), TURN_SCHEMAS).collect()
    assert sorted(r.status for r in found if r.call_id.startswith("astray")) == ["invalid"] * 2 + ["orphan"] * 4 and len(found) == 3 + 6
    contents = sorted(str(json.loads(r.line)["result"]["content"]) for r in found if r.status == "orphan")
    assert contents == ["None", "x", "x", "y"]
    empty = calls_of_turns(spark.createDataFrame([], schema))
    assert linked_calls(*empty, TURN_SCHEMAS).count() == 0


def test_schemas():
    assert conforms([1, 2.5], {"type": "array", "items": {"type": "number"}}) and not conforms(True, {"type": "integer"})
    assert not conforms("", {"minLength": 1}) and conforms(None, {"type": ["null", "string"]}) and not conforms(3, {"enum": [1, 2]})
