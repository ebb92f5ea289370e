"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from trellis.llm import op1_minhash, op2_mix, op3_lines, op4_decontaminate, op5_topk, op6_language, op7_quality, op8_shard, op9_suffix_tree, op10_urls

OPERATORS = {
    "op1_near_dedup": op1_minhash,
    "op2_mix": op2_mix,
    "op3_line_dedup": op3_lines,
    "op4_decontaminate": op4_decontaminate,
    "op5_top_k": op5_topk,
    "op6_language_id": op6_language,
    "op7_quality": op7_quality,
    "op8_shard": op8_shard,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_url_filter": op10_urls,
}
QUERIES = {name: module.query for name, module in OPERATORS.items()}
SQL = {name: module.SQL for name, module in OPERATORS.items() if module.SQL}
