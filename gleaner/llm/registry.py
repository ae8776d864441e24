"""Queries of the training-data operators and the SQL that checks them where SQL can."""

from __future__ import annotations

from gleaner.llm import q_ann, q_chat, q_decontam, q_dedup, q_hardneg, q_langid, q_lm, q_merkle, q_quality, q_tokens, q_wrapper


def queries() -> dict:
    return {
        "op1_chat_format": q_chat.op1_chat_format,
        "op2_language_id": q_langid.op2_language_id,
        "op3_pack": q_tokens.op3_pack,
        "op4_suffix_dedup": q_dedup.op4_suffix_dedup,
        "op5_token_file": q_tokens.op5_token_file,
        "op6_ann_search": q_ann.op6_ann_search,
        "op7_minhash_dedup": q_dedup.op7_minhash_dedup,
        "op8_lm_score": q_lm.op8_lm_score,
        "op9_ordinal_quality": q_quality.op9_ordinal_quality,
        "op10_decontaminate": q_decontam.op10_decontaminate,
        "op11_html_extraction": q_wrapper.op11_html_extraction,
        "op12_merkle_manifest": q_merkle.op12_merkle_manifest,
        "op13_hard_negatives": q_hardneg.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": q_chat.ORACLE,
        "op11_html_extraction": q_wrapper.ORACLE,
        "op12_merkle_manifest": q_merkle.ORACLE,
        "op13_hard_negatives": q_hardneg.ORACLE,
    }
