"""Queries of this package over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from offerlens.llm import (
    chat_format, decontaminate, embedding_dedup, hard_negatives, language_id, licenses, line_dedup, maxent_lm, resampling, sentencepiece_bpe, simhash, substring_dedup, url_filters,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "page_language": language_id.page_language,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_lm_scoring": maxent_lm.op6_lm_scoring,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_sentencepiece": sentencepiece_bpe.op8_sentencepiece,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_chat_format": chat_format.op12_chat_format,
    "chat_turns": chat_format.chat_turns,
    "op13_importance_resampling": resampling.op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_license_scan": licenses.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "chat_turns": chat_format.CHAT_TURNS_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
