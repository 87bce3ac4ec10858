"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, decontam, pii, quality, shards, simhash, substrings, tokencount, toolcalls, urls


def queries() -> dict:
    return {
        "op1_tool_calls": toolcalls.op1_tool_calls,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_token_counts": tokencount.op5_token_counts,
        "op6_shards": shards.op6_shards,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_pii": pii.op9_pii,
        "op10_url_filters": urls.op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_calls": toolcalls.SQL, "op3_substring_dedup": substrings.SQL, "op4_decontamination": decontam.SQL, "op7_quality_rules": quality.SQL}
