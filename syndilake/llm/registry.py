"""The operators' queries for __spark_entry__.py: each over its whole table, with production parameters."""

from __future__ import annotations

from . import bpe, chat, media, mixing, neighbours, pii, secrets, simhash, tokens, toxicity

QUERIES = {
    "op1_tokens": tokens.query,
    "op2_media": media.query,
    "op3_bpe": bpe.query,
    "op4_simhash": simhash.query,
    "op5_pii": pii.query,
    "op6_secrets": secrets.query,
    "op7_toxicity": toxicity.query,
    "op8_chat": chat.query,
    "op9_mixing": mixing.query,
    "op10_neighbours": neighbours.query,
    "pii_base_counts": pii.base_counts,
    "secret_base_counts": secrets.base_counts,
}
SQL = {
    "op2_media": media.SQL,
    "op8_chat": chat.SQL,
    "op9_mixing": mixing.SQL,
    "pii_base_counts": pii.SQL,
    "secret_base_counts": secrets.SQL,
}
