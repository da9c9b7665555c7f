"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tesserae.llm import byte_bpe, chat, filter_audit, language, licenses, lm, media, near_dedup, packing, prefix_trie, quality, substring_dedup, token_counts

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_language_id": language.op5_language_id,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_media_columns": media.op10_media_columns,
    "op11_conversation_prefix_trie": prefix_trie.op11_conversation_prefix_trie,
    "op12_filter_interaction_audit": filter_audit.op12_filter_interaction_audit,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
#: Tokenizers, fitted models, packing and media formats are beyond SQL; tests hold them against brute force.
ORACLES = {
    "op1_quality_rules": quality.SQL,
    "op2_license_scans": licenses.SQL,
    "op6_chat_formatting": chat.SQL,
    "op7_lm_scoring": lm.SQL,
    "op9_minhash_near_dedup": near_dedup.SQL,
    "op11_conversation_prefix_trie": prefix_trie.SQL,
    "op12_filter_interaction_audit": filter_audit.SQL,
    "op13_substring_dedup": substring_dedup.SQL,
}
