"""The queries of this package, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from lexispark.llm import byte_bpe, chat, exact_dedup, language_id, packing, quality, simhash, substring_dedup, token_file, topk

QUERIES = {
    "op1_token_file": token_file.op1_token_file,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_topk": topk.op4_topk,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_chat": chat.op7_chat,
    "op8_language_id": language_id.op8_language_id,
    "op9_packing": packing.op9_packing,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_topk": topk.SQL,
    "op7_chat": chat.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
