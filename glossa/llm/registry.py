"""Queries of the training-data operators."""

from __future__ import annotations

from . import chat, decontaminate, lm, merkle, pieces, pii, quality, secrets, sharding, simhash, tokens, toxicity, whitening

QUERIES: dict = {
    "op1_quality_rules": quality.op1,
    "op2_simhash": simhash.op2,
    "op3_token_files": tokens.op3,
    "op4_pii": pii.op4,
    "op5_pieces": pieces.op5,
    "op6_secrets": secrets.op6,
    "op7_ctw_scores": lm.op7,
    "op8_toxicity": toxicity.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_sharding": sharding.op10,
    "op11_whitening": whitening.op11,
    "op12_chat": chat.op12,
    "op13_merkle": merkle.op13,
}

#: The other operators are tokenizers, hashes, trained models or placements, which SQL has no words for; their tests use brute force.
ORACLES: dict[str, str] = {"op1_quality_rules": quality.ORACLE, "op12_chat": chat.ORACLE, "op13_merkle": merkle.ORACLE}
