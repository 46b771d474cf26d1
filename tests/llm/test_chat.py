"""Tool calls: linking, levels of long chains, validation, canonical JSON."""

import json

from claimscope.llm.chat import SCHEMAS, link_tool_calls

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def call(conv, turn, ident, name="search", args=None, after=None):
    args = {"query": "q", "limit": 1} if args is None else args
    return (conv, turn, "assistant", json.dumps({"tool_call": {"id": ident, "name": name, "arguments": args, "after": after}}))


def result(conv, turn, ident, content="done"):
    return (conv, turn, "tool", json.dumps({"tool_result": {"id": ident, "content": content}}))


def linked(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS call_id", "2 AS level", "'x' AS status")
    return {(r["conv_id"], r["call_id"], r["turn"]): r for r in link_tool_calls(df, SCHEMAS).collect()}


def test_status_errors_and_canonical_json(spark):
    text = 'quote " back \\ line\n tab\t é 😀 \x01'
    rows = [
        call(1, 0, "a", args={"query": text, "limit": 2}), result(1, 1, "a", text), result(1, 5, "a", "late"),
        call(1, 2, "b", "lookup", {"strict": True, "key": "k"}, "a"), result(1, 3, "b", ""),
        call(1, 4, "c", "note", {"size": "3", "body": [1]}), call(1, 6, "d", "note", {"body": "x", "z": {"b": 1, "a": [True, None, 1.5]}}),
        call(1, 7, "e", "rm"), call(1, 8, "f", args=[1]), call(1, 9, "g", after="nobody"), call(1, 10, "h", after="i"), call(1, 11, "i", after="h"),
        call(1, 12, "j", after="h"), call(1, 13, "a"), result(1, 14, "ghost"), call(1, 15, "k", after="g"), call(2, 0, "a"), call(None, 0, "a"), result(None, 1, "a"),
        (1, 20, "assistant", None), (1, 21, "assistant", ""), (1, 22, "tool", "{"), (1, 23, "user", rows_text()), (3, 0, "assistant", '{"tool_call": {"id": "n", "name": "search", "arguments": null}}'),
    ]
    got = linked(spark, rows)
    status = {k: (r["status"], r["errors"], r["level"]) for k, r in got.items()}
    assert status == {
        (1, "a", 0): ("ok", "", 0), (1, "b", 2): ("ok", "", 1), (1, "c", 4): ("invalid", "type:body,type:size", 0), (1, "d", 6): ("invalid", "extra:z,missing:size", 0),
        (1, "e", 7): ("invalid", "unknown_tool", 0), (1, "f", 8): ("invalid", "bad_arguments", 0), (1, "g", 9): ("no_dependency", "", None), (1, "h", 10): ("cycle", "", None),
        (1, "i", 11): ("cycle", "", None), (1, "j", 12): ("cycle", "", None), (1, "a", 13): ("repeated_id", "", None), (1, "ghost", None): ("orphan_result", "", None),
        (1, "k", 15): ("no_dependency", "", None), (2, "a", 0): ("no_result", "", 0), (None, "a", 0): ("ok", "", 0), (3, "n", 0): ("invalid", "bad_arguments", 0),
    }
    first = got[1, "a", 0]
    assert (first["result_turn"], first["n_results"]) == (1, 2)
    assert json.loads(first["canonical"]) == {"arguments": {"limit": 2, "query": text}, "id": "a", "name": "search", "result": text}
    plain = got[1, "d", 6]["canonical"]
    assert plain == json.dumps(json.loads(plain), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def rows_text():
    return call(1, 0, "user-is-no-caller")[3]


def test_long_chain_in_one_conversation(spark):
    rows = [call(1, k, f"c{k}", after=f"c{k - 1}" if k else None) for k in range(130)]
    got = linked(spark, rows)
    assert {k[2]: r["level"] for k, r in got.items()} == {k: k for k in range(130)}


def test_no_rows(spark):
    assert linked(spark, []) == {}
