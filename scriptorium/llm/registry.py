"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, html_text, language_model, line_dedup, near_dedup, packing, phrases, quality, sharding, token_store

_MODULES = {
    "op1_minhash_near_dedup": near_dedup,
    "op2_host_suffix_array_text": html_text,
    "op3_attention_lm_scoring": language_model,
    "op4_content_addressed_tokens": token_store,
    "op5_bpe_encode_decode": bpe,
    "op6_virtual_slot_sharding": sharding,
    "op7_line_dedup": line_dedup,
    "op8_bottom_k_fingerprint": fingerprint,
    "op9_benchmark_decontamination": decontaminate,
    "op10_quality_classifier": quality,
    "op11_phrase_collocations": phrases,
    "op12_histogram_packing": packing,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
