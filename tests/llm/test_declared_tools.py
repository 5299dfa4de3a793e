"""Conversations declare their tools, so the check of arguments has its say in the query as well."""

import json

from siftline.llm import chat, registry
from siftline.session import ship

SCHEMA = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 3}}, "required": ["n"]}
SCHEMAS = {"content": "be brief", "tools": [{"name": "f", "parameters": SCHEMA}, {"name": "g"}]}


def calls(*made):
    return json.dumps({"content": None, "tool_calls": [{"id": f"c{i}", "name": name, "arguments": a} for i, (name, a) in enumerate(made)]})


TURNS = [
    (1, 0, "system", json.dumps(SCHEMAS)), (1, 1, "assistant", calls(("f", {"n": 1}), ("f", {"n": 3}), ("g", {"x": 1}), ("h", {}), ("f", {"n": "$c1"}), ("f", {"n": "$no"}))),
    (2, 0, "assistant", calls(("f", {"n": 1}))), (3, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": {"unheard": 1}}]})), (3, 1, "assistant", calls(("f", {"n": 1}))),
    (None, 0, "system", json.dumps(SCHEMAS)), (None, 1, "assistant", calls(("f", {"n": 1}))),
]


def test_query_checks_against_declared_tools(spark, tmp_path):
    ship(spark).createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in registry.op5_chat_format(spark, str(tmp_path)).collect()}
    assert len(got) == len(TURNS) and {k: r.n_invalid for k, r in got.items() if r.n_calls} == {(1, 1): 3, (2, 0): 0, (3, 1): 0, (None, 1): 0}
    told = json.loads(got[1, 1].message)["tool_calls"]
    assert [c.get("errors") for c in sorted(told, key=lambda c: c["id"])] == [["/n: below minimum"], None, None, ["unknown tool"], None, ["/n: not integer"]]
    assert json.loads(got[1, 0].message) == {"content": "be brief", "role": "system", "tools": [{"name": "f", "parameters": SCHEMA}, {"name": "g", "parameters": True}]}
    assert json.loads(got[3, 0].message)["content"] == TURNS[3][3]  # a schema that can't be checked


def test_declared_tools_stand_beside_given_ones(spark):
    turns = ship(spark).createDataFrame([(1, 0, "system", json.dumps(SCHEMAS)), (1, 1, "assistant", calls(("f", {"n": 5}), ("k", {"n": 9}), ("z", {})))], "conv_id long, turn long, role string, text string")
    made = {r.turn: r for r in chat.format_chat(turns, {"f": {"maxProperties": 0}, "k": {"maxProperties": 0}}).collect()}[1]
    assert [c.get("errors") for c in json.loads(made.message)["tool_calls"]] == [None, ["/: more than maxProperties"], ["unknown tool"]]


def test_declared_schemas_of_wrong_values_end_as_errors(spark):
    odd = [{"name": "f", "parameters": {"properties": {"n": {"minimum": "x"}, "m": {"multipleOf": 0}, "p": {"pattern": "("}}}}]
    turns = ship(spark).createDataFrame([(1, 0, "system", json.dumps({"tools": odd})), (1, 1, "assistant", calls(("f", {"n": 1}), ("f", {"m": 1}), ("f", {"p": "a"}), ("f", {})))], "conv_id long, turn long, role string, text string")
    assert {r.turn: r.n_invalid for r in chat.format_chat(turns).collect()} == {0: 0, 1: 3}
