"""The queries of the text operators, and the SQL that must agree with them."""

from __future__ import annotations

from . import decontaminate, divergence, importance, media, mixing, neardup, packing, quality, sharding, substring, suffix, tokens, toxicity

QUERIES = {
    "op1_token_output": tokens.op1_token_output,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_jump_sharding": sharding.op4_jump_sharding,
    "op5_toxicity_pu": toxicity.op5_toxicity_pu,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_media_gif": media.op7_media_gif,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_minhash_setsketch": neardup.op10_minhash_setsketch,
    "op11_packing": packing.op11_packing,
    "op12_divergence": divergence.op12_divergence,
    "op13_importance": importance.op13_importance,
}
ORACLE_SQL = {
    "op3_decontamination": decontaminate.ORACLE,
    "op4_jump_sharding": sharding.ORACLE,
    "op8_substring_dedup": substring.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_minhash_setsketch": neardup.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_importance": importance.ORACLE,
}
