"""Tool calls: links, levels, validation and canonical JSON in the cases that the conversations do not hold."""

import json

from scriptorium.llm import chat

DDL = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, after string, result_for string"
GOOD = '{"query": "q", "limit": 1}'


def call(conv, turn, name, after=None, tool="search", arguments=GOOD, text="t"):
    return (conv, turn, "assistant", text, name, tool, arguments, after, None)


def result(conv, turn, name, text="r"):
    return (conv, turn, "user", text, None, None, None, None, name)


def run(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", *extra).repartition(3)
    return {(r.conv_id, r.turn): r for r in chat.linked(frame).collect()}


def test_chains_cycles_and_dangling_calls(spark):
    rows = [call(1, i, f"c{i}", f"c{i - 1}" if i else None) for i in range(9)] + [call(1, 20, "x", "y"), call(1, 21, "y", "x"), call(1, 22, "z", "x"), call(1, 23, "d", "none"), call(1, 24, "e", "d"), call(1, 25, "s", "s")]
    got = run(spark, rows)
    assert [got[1, i].level for i in range(9)] == list(range(9))
    assert [got[1, i].level for i in (20, 21, 22, 25)] == [None] * 4 and all("cycle" in got[1, i].errors for i in (20, 21, 22, 25))
    assert (got[1, 23].level, got[1, 23].errors) == (0, ["dangling"]) and (got[1, 24].level, got[1, 24].errors) == (1, [])


def test_results_before_calls_repeats_orphans_and_other_conversations(spark):
    got = run(spark, [result(1, 0, "a"), call(1, 1, "a"), result(1, 2, "a"), call(1, 3, "a"), result(1, 4, "b"), call(2, 0, "b"), (1, 5, "user", "plain", None, None, None, None, None), result(None, 6, "a")])
    assert [got[1, t].status for t in range(6)] == ["linked", "answered", "linked", "repeated", "orphan", None]
    assert got[2, 0].status == "unanswered" and got[1, 5].kind == "text" and got[None, 6].status == "orphan"


def test_arguments_are_checked_and_serialised(spark):
    cases = {
        0: (call(1, 0, "a", arguments=' { "limit": 1,"query" : "é\\"x" } '), [], {"limit": 1, "query": 'é"x'}),
        1: (call(1, 1, "b", arguments="{broken"), ["not an object"], "{broken"),
        2: (call(1, 2, "c", arguments=None), ["not an object"], None),
        3: (call(1, 3, "d", arguments="[1]"), ["not an object"], [1]),
        4: (call(1, 4, "e", arguments='{"query": 5, "limit": -1}'), ["query is not string", "limit is below 0"], {"limit": -1, "query": 5}),
        5: (call(1, 5, "f", tool="nothing"), ["unknown tool"], {"limit": 1, "query": "q"}),
        6: (call(1, 6, "g", tool=None), ["unknown tool"], {"limit": 1, "query": "q"}),
        7: (call(1, 7, "h", arguments=""), ["not an object"], ""),
    }
    got = run(spark, [row for row, _, _ in cases.values()])
    for turn, (_, errors, arguments) in cases.items():
        row, message = got[1, turn], json.loads(got[1, turn].message)
        assert row.errors == errors and message["arguments"] == arguments
        assert row.message == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_empty_and_huge_texts_and_clashing_columns(spark):
    huge = 'x"\n' * 400_000
    got = run(spark, [call(1, 0, "a", text=huge), result(1, 1, "a", text=""), result(1, 2, "a", text=None)], ("1 as level", "'q' as status", "2 as known", "3 as n_calls"))
    assert json.loads(got[1, 0].message)["content"] == huge and json.loads(got[1, 1].message)["content"] == "" and json.loads(got[1, 2].message)["content"] is None
    assert [got[1, t].status for t in range(3)] == ["answered", "linked", "linked"]


def test_no_messages(spark):
    assert chat.linked(spark.createDataFrame([], DDL)).collect() == []
