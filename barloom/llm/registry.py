"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import chat, fingerprints, langid, linededup, ngramjoin, packing, pieces, quality, vectordedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_ngram_jaccard_join": ngramjoin.op2_ngram_jaccard_join,
    "op3_language_id": langid.op3_language_id,
    "op4_document_fingerprints": fingerprints.op4_document_fingerprints,
    "op5_embedding_near_dedup": vectordedup.op5_embedding_near_dedup,
    "op6_substring_dedup": linededup.op6_substring_dedup,
    "substring_dedup_every_unit": linededup.substring_dedup_every_unit,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

SQL = {
    "op1_warc": warc.SQL,
    "op2_ngram_jaccard_join": ngramjoin.SQL,
    "op5_embedding_near_dedup": vectordedup.SQL,
    "op6_substring_dedup": linededup.SQL,
    "substring_dedup_every_unit": linededup.SQL_ALL,
}
