"""Queries of the numbered operators and the SQL that gives the same rows."""

from __future__ import annotations

from fernloom.llm import chat, decontaminate, html_text, line_dedup, mixing, near_vectors, ngram_join, pii, prefix_trie, quality, secrets, substring_dedup, whitening

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_pii": pii.op6_pii,
    "op7_html_text": html_text.op7_html_text,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_embedding_dedup": near_vectors.op11_embedding_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_embedding_dedup": near_vectors.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
