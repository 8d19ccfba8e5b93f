"""Queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from twinsieve.llm import exact_dedup, jaccard, lattice_lm, mixing, packing, quality, sharding, spelling, substring_dedup, suffix_dedup, token_output, topk, vector_codes

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_consistent_hash_sharding": sharding.op4_consistent_hash_sharding,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
    "op9_token_output": token_output.op9_token_output,
    "op10_exact_top_k": topk.op10_exact_top_k,
    "op11_lattice_lm": lattice_lm.op11_lattice_lm,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_OP1,
    "op6_ngram_jaccard_join": jaccard.ORACLE_OP6,
    "op8_suffix_array_dedup": suffix_dedup.ORACLE_OP8,
    "op10_exact_top_k": topk.ORACLE_OP10,
    "op12_spelling_variants": spelling.ORACLE_OP12,
    "op13_vector_codes": vector_codes.ORACLE_OP13,
}
