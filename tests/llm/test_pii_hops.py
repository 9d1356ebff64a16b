"""Patterns that only instances of other patterns lead to."""

from flowloom.llm import pii


def test_pii_second_hop(spark):
    texts = [(i, f"please call my mobile +1 (743) 555-{1000 + i} today") for i in range(40)]
    hidden = [f"743.555.77xx{i}" for i in range(8)]
    texts += [(100 + i, f"please call my mobile {x} today") for i, x in enumerate(hidden)]
    texts += [(200 + i, f"the second desk {x} answers") for i, x in enumerate(hidden)] + [(300, "the second desk 743.555.99xx9 answers"), (301, "route 66a1 is long")]
    got = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[100] == [(22, 3, 35)]
    assert got[300] == [(16, 3, 29)] and got[301] == []
