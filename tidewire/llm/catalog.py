"""Registered queries of the training-data operators: name -> (query, SQL or None)."""

from __future__ import annotations

from tidewire.llm import decontaminate, language_id, line_dedup, ngram_join, pii, prefix_trie, quality_rules, recompression, secret_scan, sentence_pieces, sharding, spelling_variants, token_store

QUERIES = {
    "op1_secret_scan": (secret_scan.query, None),
    "op2_quality_rules": (quality_rules.query, quality_rules.SQL),
    "op3_pii": (pii.query, None),
    "op4_sharding": (sharding.query, None),
    "op5_sentence_pieces": (sentence_pieces.query, None),
    "op6_language_id": (language_id.query, None),
    "op7_ngram_join": (ngram_join.query, None),
    "op8_line_dedup": (line_dedup.query, None),
    "op9_decontaminate": (decontaminate.query, None),
    "op10_token_store": (token_store.query, None),
    "op11_recompression": (recompression.query, recompression.SQL),
    "op12_prefix_trie": (prefix_trie.query, prefix_trie.SQL),
    "op13_spelling_variants": (spelling_variants.query, None),
}
