"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from cleargrain.llm import chat_format, flac, harmonic_packing, language_id, minhash_tensor, mixing, quality_rules, recurrent_lm, suffix_dedup, url_filter

QUERIES = {
    "op3_recurrent_lm": recurrent_lm.op3_recurrent_lm,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op1_url_filter": url_filter.op1_url_filter,
    "op5_chat_format": chat_format.op5_chat_format,
    "op4_flac": flac.op4_flac,
    "op9_mixing": mixing.op9_mixing,
    "op6_harmonic_packing": harmonic_packing.op6_harmonic_packing,
    "op10_minhash_near_dedup": minhash_tensor.op10_minhash_near_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
}

ORACLE_SQL = {
    "op5_chat_format": chat_format.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op1_url_filter": url_filter.SQL,
    "op10_minhash_near_dedup": minhash_tensor.SQL,
    "op2_quality_rules": quality_rules.SQL,
}
