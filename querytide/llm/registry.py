"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, decontaminate, kdtree, langid, mixing, quality, secrets, simhash, substring_dedup, suffix_dedup, surrogates, toxicity, trie

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": langid.op3_language_id,
    "op4_pii_surrogates": surrogates.op4_pii_surrogates,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_secret_linking": secrets.op8_secret_linking,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_compression_quality": quality.op10_compression_quality,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_exact_top_k": kdtree.op12_exact_top_k,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op7_suffix_array_dedup": suffix_dedup.ORACLE,
    "op12_exact_top_k": kdtree.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
