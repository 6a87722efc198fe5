"""Contract queries and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, langid, lm, mixing, sharding, tokenids, urls, vectors

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_token_ids": tokenids.op2_token_ids,
    "op3_embedding_dedup": vectors.op3_embedding_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_url_filter": urls.op6_url_filter,
    "op7_chat_format": chat.op7_chat_format,
    "op8_sharding": sharding.op8_sharding,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {"op6_url_filter": urls.SQL, "op7_chat_format": chat.SQL, "op10_decontaminate": decontaminate.SQL}
