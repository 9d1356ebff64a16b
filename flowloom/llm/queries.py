"""The ten queries and the pipeline, as __spark_entry__.py registers them."""

from __future__ import annotations

import corpus_pipeline
from flowloom.llm import exact_dedup, language_id, packing, pieces, pii, quality, simhash_dedup, substring_dedup, tool_calls, tool_chat, topk_search

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_language_id": language_id.query,
    "op3_packing": packing.query,
    "op4_tool_chat": tool_chat.query,
    "tool_calls": tool_calls.query,
    "op5_pii": pii.query,
    "op6_simhash_dedup": simhash_dedup.query,
    "op7_pieces": pieces.query,
    "op8_quality": quality.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_topk_search": topk_search.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_tool_chat": tool_chat.ORACLE,
    "tool_calls": tool_calls.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_topk_search": topk_search.ORACLE,
}
