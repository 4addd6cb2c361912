"""The registered queries of the training-text operators and the SQL that checks them."""

from __future__ import annotations

from phonoscope.llm import chat_format, decontaminate, exact_dedup, language_id, mixing, passage_dedup, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language_id": language_id.op2_language_id,
    "op3_passage_dedup": passage_dedup.op3_passage_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {**mixing.ORACLE, **suffix_dedup.ORACLE, **chat_format.ORACLE, **exact_dedup.ORACLE}
