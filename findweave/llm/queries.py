"""Queries of the text operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from findweave.llm import ann, bpe, hmm_lm, jaccard_join, merkle, near_dedup, packing, phrases, pii, quality_classifier, quality_rules, sharding, toxicity

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_sharding": sharding.op2_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_hmm_lm": hmm_lm.op5_hmm_lm,
    "op6_bpe": bpe.op6_bpe,
    "op7_ann": ann.op7_ann,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_pii": pii.op9_pii,
    "op10_packing": packing.op10_packing,
    "op11_phrases": phrases.op11_phrases,
    "op12_merkle": merkle.op12_merkle,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}

ORACLES = {
    "op2_sharding": sharding.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_jaccard_join": jaccard_join.ORACLE,
}
