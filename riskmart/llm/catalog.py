"""Queries of this subpackage, by name, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from riskmart.llm import (binary_output, conversation_repair, decontamination, line_dedup, merkle_manifest, ngram_join, packing,
                          pii, quality_rules, resharding, simhash_join, token_counts, toxicity)

QUERIES = {
    "op1_fuzzy_lines": line_dedup.op1_fuzzy_lines,
    "op2_flow_resharding": resharding.op2_flow_resharding,
    "op3_edit_decontamination": decontamination.op3_edit_decontamination,
    "op4_bitpacked_ids": binary_output.op4_bitpacked_ids,
    "op5_nnpu_toxicity": toxicity.op5_nnpu_toxicity,
    "op6_risk_controlled_rules": quality_rules.op6_risk_controlled_rules,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_separator_scan": token_counts.op8_separator_scan,
    "op9_retrieval_packing": packing.op9_retrieval_packing,
    "op10_disclosure_sanitiser": pii.op10_disclosure_sanitiser,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_simhash_trie": simhash_join.op13_simhash_trie,
}
ORACLES: dict[str, str] = {}
