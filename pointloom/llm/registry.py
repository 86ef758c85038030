"""Queries of the subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pointloom.llm import chat, exact_dedup, jaccard, language, mixing, packing, quality_model, quality_rules, toxicity, warc


def queries():
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_quality": quality_model.op3_quality,
        "op4_language": language.op4_language,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_mixing": mixing.op6_mixing,
        "op7_chat": chat.op7_chat,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_packing": packing.op9_packing,
        "op10_warc": warc.op10_warc,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op2_jaccard": jaccard.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op7_chat": chat.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op10_warc": warc.ORACLE,
    }
