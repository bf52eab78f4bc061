"""Queries of this subpackage and their SQL, for registration by the driver contract."""

from __future__ import annotations

from lexiquarry.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_language_id": language_id.op5_language_id,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_sharding": sharding.op9_sharding,
    "op10_ngram_jaccard": near_dedup.op10_ngram_jaccard,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_line_dedup": line_dedup.SQL,
}
