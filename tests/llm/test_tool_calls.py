"""Made conversations with calls: the operator against DuckDB, on whole tables."""

from collections import Counter

from conftest import DATA

from flowloom.llm import tool_calls, tool_chat, topk_search


def same(spark, duck, query, oracle):
    got = query(spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(oracle)
    at = [[c[0] for c in want.description].index(c) for c in cols]
    have = Counter(str(tuple(r)) for r in got.select(*cols).collect())
    assert have == Counter(str(tuple(r[i] for i in at)) for r in want.fetchall())
    return have


def test_tool_calls(spark, duck):
    events = same(spark, duck, tool_calls.query, tool_calls.ORACLE)
    for word in ("duplicate_id", "bad_json", "unknown_tool", "missing:url", "type:query", "type:arguments", "extra:more", "unordered", "orphan"):
        assert any(f"'{word}" in e or f",{word}" in e for e in events), word


def test_plain_conversations(spark, duck):
    same(spark, duck, tool_chat.query, tool_chat.ORACLE)


def test_topk_oracle(spark, duck):
    same(spark, duck, topk_search.query, topk_search.ORACLE)
