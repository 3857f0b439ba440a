"""The queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from tilework.llm import bpe, decontaminate, divergence, exact_dedup, jaccard_join, language, lm_scoring, mixing, negatives, secrets, sharding, substring_dedup, toxicity


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_secret_scans": secrets.op3_secret_scans,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_language_id": language.op7_language_id,
        "op8_sharding": sharding.op8_sharding,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_negatives": negatives.op11_negatives,
        "op12_divergence": divergence.op12_divergence,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql():
    return {
        "op4_decontamination": decontaminate.OP4_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
        "op11_negatives": negatives.OP11_SQL,
        "op12_divergence": divergence.OP12_SQL,
    }
