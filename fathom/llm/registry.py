"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from fathom.llm import chat, fingerprints, language, language_model, media, mixing, neardup, packing, token_counts, toxicity


def queries():
    return {"op1_chat": chat.op1_chat, "op2_media": media.op2_media, "op3_token_counts": token_counts.op3_token_counts, "op4_language": language.op4_language, "op5_packing": packing.op5_packing, "op6_fingerprints": fingerprints.op6_fingerprints, "op7_toxicity": toxicity.op7_toxicity, "op8_language_model": language_model.op8_language_model, "op9_mixing": mixing.op9_mixing, "op10_neardup": neardup.op10_neardup}


def oracle_sql():
    return {"op1_chat": chat.ORACLE, "op9_mixing": mixing.ORACLE, "op10_neardup": neardup.ORACLE}
