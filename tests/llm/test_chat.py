"""Linking, order, schema checks and canonical JSON, against plain Python."""

import json
import random

from leafquire.llm import chat


def run(spark, calls, results, tools=None):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, turn long, name string, arguments string, depth int")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    return {(x.conv_id, x.call_id): x for x in chat.link(c, r, chat.schemas(spark, tools or {"t": {"type": "object"}})).collect()}


def test_link_and_order(spark):
    calls = [
        (1, "c", "b", 5, "t", '{"z": 1, "a": [1.5, true, null, "é\\n"]}', 0), (1, "a", None, 1, "t", "{}", 0), (1, "b", "a", 9, "t", "{}", 0),
        (1, "x", "y", 2, "t", "{}", 0), (1, "y", "x", 3, "t", "{}", 0), (1, "lost", "gone", 4, "t", "[1]", 0), (2, "a", None, 1, "no", "{", 0),
        (2, "a", None, 1, "no", "{", 0), (None, "q", None, 1, "t", "{}", 0), (3, None, None, 1, "t", "{}", 0), (4, "n", None, 0, None, None, 0),
    ]
    results = [(1, "a", 2, "first"), (1, "orphan", 7, None), (2, "a", 4, None), (None, "a", 1, "x")]
    got = run(spark, calls[:7] + calls[8:], results)
    assert set(got) == {(1, k) for k in ("a", "b", "c", "x", "y", "lost", "orphan")} | {(2, "a"), (4, "n")}
    order = sorted((v.position, k[1]) for k, v in got.items() if k[0] == 1 and v.position is not None)
    assert order == [(0, "a"), (1, "lost"), (2, "b"), (3, "c")]
    assert [got[1, k].depth for k in ("a", "b", "c", "lost", "x", "y", "orphan")] == [0, 1, 2, 0, None, None, None]
    assert got[1, "c"].message == '{"arguments":{"a":[1.5,true,null,"é\\n"],"z":1},"call_id":"c","conversation":1,"name":"t","result":null}'
    assert json.loads(got[1, "a"].message)["result"] == "first"
    assert got[1, "orphan"].has_result and got[1, "orphan"].valid is None
    assert got[1, "lost"].errors == ["$: not object"] and got[2, "a"].errors == ["$: not JSON"] and got[2, "a"].has_result
    assert got[4, "n"].errors == ["$: no schema"]


def test_order_of_random_forests(spark):
    rng = random.Random(4)
    calls, parent = [], {}
    for conv in range(6):
        n = rng.choice([1, 5, 40, 3000])
        turns = rng.sample(range(3 * n), n)
        for i in range(n):
            p = f"k{rng.randrange(max(0, i - 3), i)}" if i and rng.random() < 0.9 else None
            parent[conv, f"k{i}"] = p
            calls.append((conv, f"k{i}", p, turns[i], "t", "{}", 0))
    got = run(spark, calls, [])
    for (conv, k), p in parent.items():
        if p:
            assert got[conv, p].position < got[conv, k].position and got[conv, k].depth == got[conv, p].depth + 1
    for conv in range(6):
        at = sorted(v.position for (c, _), v in got.items() if c == conv)
        assert at == list(range(len(at)))


def test_schema_keywords():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
        "a": {"type": "integer", "minimum": 1, "maximum": 3}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2, "minLength": 1}}, "c": {"enum": [1, "x"]}}}
    assert chat.violations({"a": 2, "b": ["x"], "c": "x"}, schema) == []
    assert chat.violations({"a": True}, schema) == ["$.a: not integer"]
    assert chat.violations({"b": ["xyz", "", 1], "c": 2, "d": 0}, schema) == [
        "$.a: missing", "$.b[0]: too long", "$.b[1]: too short", "$.b[2]: not string", "$.c: not in enum", "$.d: unknown"]
    assert chat.violations({"a": 9}, schema) == ["$.a: out of range"]


def test_arguments_that_have_no_canonical_form(spark):
    bad = {
        "deep": "[" * 100_000 + "]" * 100_000, "half": '{"a":"\\ud800"}', "key": '{"\\udfff":1}', "large": '{"a":1e999}', "small": '{"a":-1e999}',
        "nan": '{"a":NaN}', "inf": '{"a":Infinity}', "digits": '{"a":' + "9" * 5000 + "}", "long": '{"a":"' + "x" * 300_000 + '"}', "pair": '{"a":"\\ud83d\\ude00"}',
    }
    got = run(spark, [(1, k, None, 1, "t", v, 0) for k, v in bad.items()], [(1, k, 2, "r") for k in bad])
    errors = {k: got[1, k].errors for k in bad}
    assert errors == {
        "deep": ["$: nested too deep"], "half": ["$: lone surrogate"], "key": ["$: lone surrogate"], "large": ["$: not finite"], "small": ["$: not finite"],
        "nan": ["$: not JSON"], "inf": ["$: not JSON"], "digits": ["$: not JSON"], "long": [], "pair": [],
    }
    for k in bad:
        assert got[1, k].valid == (not errors[k])
        assert json.loads(got[1, k].message, parse_constant=chat._refuse)["result"] == "r"
    assert json.loads(got[1, "pair"].message)["arguments"] == {"a": "😀"}


def test_repeats_are_rows_of_their_own(spark):
    calls = [(1, "a", None, 1, "t", "{}", 0)] * 3 + [(1, "a", None, 2, "t", "[", 0), (1, "b", "a", 3, "t", "{}", 0)]
    results = [(1, "a", 5, "x"), (1, "a", 5, "x"), (1, "a", 6, "y"), (1, "z", 7, None), (1, "z", 7, None)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, turn long, name string, arguments string, depth int")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    got = chat.link(c, r, chat.schemas(spark, {"t": {"type": "object"}})).collect()
    seen = sorted((x.call_id, x.turn, x.has_result, str(x.valid), "; ".join(x.errors or []), x.position is not None) for x in got)
    call, result = "$: repeated call", "$: repeated result"
    assert seen == sorted([
        ("a", 1, True, "True", "", True), ("a", 1, False, "False", call, False), ("a", 1, False, "False", call, False),
        ("a", 2, False, "False", f"$: not JSON; {call}", False), ("b", 3, False, "True", "", True),
        ("a", 5, True, "None", result, False), ("a", 6, True, "None", result, False), ("z", 7, True, "None", "", False), ("z", 7, True, "None", result, False),
    ])


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert chat.op1_chat(spark, "/root/testdata/sf0.001").where("message IS NULL").count() == 0
