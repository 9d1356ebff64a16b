"""Long chains of calls."""

import json

from flowloom.llm import tool_chat


def call(i, after):
    return f"<tool_call>{json.dumps({'id': i, 'name': 'search', 'arguments': {'query': 'x'}, 'after': after})}</tool_call>"


def test_chain_over_a_thousand(spark):
    n = 1100
    chain = [call(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]
    more = [call("join", ["c7", f"c{n - 1}"]), call("tail", ["join"]), call("loop", ["loop2"]), call("loop2", ["loop"]), call("behind", ["loop"]), call("self", ["self"]), call("mixed", ["c0", "loop"]), call("lost", ["nowhere"])]
    df = spark.createDataFrame([(1, 0, "assistant", "".join(chain + more))], "conv_id long, turn long, role string, text string")
    got = {r.call_id: (r.o_level, r.error) for r in tool_chat.format_chat(df).collect() if r.kind == "call"}
    assert all(got[f"c{i}"] == (i, None) for i in range(n))
    assert got["join"] == (n, None) and got["tail"] == (n + 1, None)
    assert all(got[x] == (None, "unordered") for x in ("loop", "loop2", "behind", "self", "mixed", "lost"))


def test_several_predecessors(spark):
    """Each call comes after the two before it; half of them in another order in the text."""
    n = 14
    blocks = [call(f"c{i}", [f"c{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(n)]
    df = spark.createDataFrame([(1, 0, "assistant", "".join(blocks[::2] + blocks[1::2]))], "conv_id long, turn long, role string, text string")
    got = {r.call_id: (r.o_level, r.error) for r in tool_chat.format_chat(df).collect() if r.kind == "call"}
    assert got == {f"c{i}": (i, None) for i in range(n)}


def test_shapes_and_numbers(spark):
    raw = lambda x: f"<tool_call>{x}</tool_call>"
    big = "123456789012345678901234567890123456789012"
    texts = [
        '{"id":"1","name":"search","arguments":[1]}', '{"id":"2","name":"search","arguments":{"query":"x"},"after":"1"}', '{"id":"3","name":"search","arguments":{"query":"x","limit":18446744073709551616}}',
        f'{{"name":"search","id":"4","arguments":{{"query":"{big} \\" {big}","limit":{big}}}}}', '{"id":"5","name":"classify","arguments":{"text":"","labels":[-' + big + ".5e1000" + '],"threshold":1e400}}',
        '{"id":"6","name":"search","arguments":{"query":"a <\\/tool_call> b"}}', '{"id":"7","name":"search"}', '{"id":"8","name":"search","arguments":{"query":"x","limit":0' + big + "}}", '{"id":"9","name":"search","arguments":"x"}',
        f'{{"id":"10","name":"search","arguments":{{"query":"{big}"}}}}', '{"id":"11","name":"search","arguments":{"query":"x","limit":1.5}}', '{"id":"12","name":"search","arguments":{"query":null}}',
    ]
    df = spark.createDataFrame([(1, 0, "assistant", "".join(map(raw, texts)), 1, 2, 3)], "conv_id long, turn long, role string, text string, mid int, v int, place int")
    got = {r.o_place: r for r in tool_chat.format_chat(df).collect() if r.kind == "call"}
    errors = [got[i].error for i in range(len(texts))]
    assert errors == ["type:arguments", "type:after", None, None, None, None, "missing:query", "bad_json", "type:arguments", None, "type:limit", "type:query"]
    assert got[2].json == '{"arguments":{"limit":18446744073709551616,"query":"x"},"id":"3","name":"search"}'
    assert got[3].json == f'{{"arguments":{{"limit":{big},"query":"{big} \\\\" {big}"}},"id":"4","name":"search"}}'.replace('\\\\"', '\\"')
    assert f"-{big}.5e1000" in got[4].json and "1e400" in got[4].json
    assert json.loads(got[5].json)["arguments"]["query"] == "a </tool_call> b" and got[9].json.count(f'"{big}"') == 1
