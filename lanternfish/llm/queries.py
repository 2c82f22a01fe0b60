"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from lanternfish.llm import op01_quality, op02_lines, op03_jaccard, op04_toxicity, op05_shards, op06_pack, op07_media, op08_counts, op09_pii, op10_mix

QUERIES = {
    "op1_quality_rules": op01_quality.op1_quality_rules,
    "op1_quality_joint": op01_quality.op1_quality_joint,
    "op2_line_dedup": op02_lines.op2_line_dedup,
    "op3_ngram_jaccard": op03_jaccard.op3_ngram_jaccard,
    "op4_toxicity": op04_toxicity.op4_toxicity,
    "op5_feistel_shards": op05_shards.op5_feistel_shards,
    "op6_best_fit_pack": op06_pack.op6_best_fit_pack,
    "op7_media_columns": op07_media.op7_media_columns,
    "op7_page_elements": op07_media.op7_page_elements,
    "op8_token_counts": op08_counts.op8_token_counts,
    "op9_pii_surrogates": op09_pii.op9_pii_surrogates,
    "op10_mix_sources": op10_mix.op10_mix_sources,
}

ORACLES = {
    "op1_quality_rules": op01_quality.ORACLE,
    "op1_quality_joint": op01_quality.JOINT_ORACLE,
    "op2_line_dedup": op02_lines.ORACLE,
    "op3_ngram_jaccard": op03_jaccard.ORACLE,
    "op5_feistel_shards": op05_shards.ORACLE,
    "op10_mix_sources": op10_mix.ORACLE,
}
