"""Queries of this subpackage and the SQL that gives their rows, by name."""

from __future__ import annotations

from arbora.llm import byte_bpe, chat_format, host_quality, lm_score, mih, mixing, prob_minhash, token_counts, toxicity, url_rules

QUERIES = {
    "op1_host_quality": host_quality.op1_host_quality,
    "op2_mih": mih.op2_mih,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_mixing": mixing.op5_mixing,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_prob_minhash": prob_minhash.op9_prob_minhash,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {"op1_host_quality": host_quality.ORACLE, "op3_token_counts": token_counts.ORACLE, "op7_chat_format": chat_format.ORACLE}
