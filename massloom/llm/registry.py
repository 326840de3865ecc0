"""Queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import chat, embedding_dedup, minhash, mixing, packing, quality_classifier, quality_rules, secrets, sharding, toxicity

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_packing": packing.op3_packing,
    "op7_mixing": mixing.op7_mixing,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_sharding": sharding.op6_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
}
ORACLE_SQL = {
    "op1_minhash_dedup": minhash.ORACLE_SQL,
    "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op2_chat_formatting": chat.ORACLE_SQL,
    "op4_secret_scan": secrets.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
}
