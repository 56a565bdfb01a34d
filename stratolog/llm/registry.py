"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from stratolog.llm import chat, chunks, lm, near, packing, pieces, quality, suffix, toxicity, vectors

QUERIES = {
    "op1_substring_dedup": chunks.query,
    "op2_chat_format": chat.query,
    "op3_toxicity": toxicity.query,
    "op4_packing": packing.query,
    "op5_lm_scoring": lm.query,
    "op6_minhash_dedup": near.query,
    "op7_suffix_dedup": suffix.query,
    "op8_embedding_dedup": vectors.query,
    "op9_quality_rules": quality.query,
    "op10_sentencepiece": pieces.query,
}

ORACLES = {
    "op2_chat_format": chat.ORACLE,
    "op6_minhash_dedup": near.ORACLE,
    "op8_embedding_dedup": vectors.ORACLE,
    "op9_quality_rules": quality.ORACLE,
}
