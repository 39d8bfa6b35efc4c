"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import chat_format, conversation_repair, embedding_dedup, exact_dedup, html_extract, minhash_dedup, mixing, packing, sharding, substring_dedup, token_alignment, toxicity, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_chat_format": chat_format.op13_chat_format,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_chat_format": chat_format.OP13_SQL,
}
