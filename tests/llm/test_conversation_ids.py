"""Calls of turns that lack a part of their id."""

from podweave.llm import tool_calls


def test_calls_without_conversation_or_turn_are_linked_with_nothing(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", "c"), (None, 2, "user", "d"),
            (1, None, "user", "e"), (1, None, "user", "f"), (1, 0, "user", "g"), (1, 1, "assistant", "h"), (1, 2, "system", "i")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.link_calls(*tool_calls.conversation_calls(table)).where("json IS NOT NULL").collect()
    loose = [x for x in got if x.call_id is None]
    assert len(got) == 6 and len(loose) == 5
    for x in loose:
        assert x.n_results == 0 and "duplicate id" not in x.problems and "no result" in x.problems
    assert [(x.call_id, x.n_results) for x in got if x.call_id] == [("1:0", 1)]
