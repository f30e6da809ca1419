"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import decontaminate, fingerprint, jaccard, language, lm_score, packing, quality, suffix_dedup, tokens, toxicity

QUERIES = {
    "op1_quartile_digest": fingerprint.op1_quartile_digest,
    "op2_context_tree": lm_score.op2_context_tree,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_language": language.op10_language,
}

SQL = {
    "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op3_jaccard_join": jaccard.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
}
