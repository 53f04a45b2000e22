"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, binary_records, chat, decontam, hardneg, hnsw, html_extract, langid, line_dedup, mixing, ngram_join, tokalign, url_filter

QUERIES = {
    "op1_html_extraction": html_extract.query,
    "op2_ngram_jaccard_join": ngram_join.query,
    "op3_benchmark_decontamination": decontam.query,
    "op4_language_id": langid.query,
    "op5_binary_records": binary_records.query,
    "op6_chat_formatting": chat.query,
    "op7_source_mixing": mixing.query,
    "op8_url_filters": url_filter.query,
    "op9_line_dedup": line_dedup.query,
    "op10_nearest_neighbours": ann.query,
    "op11_embedding_near_dedup": hnsw.query,
    "op12_token_alignment": tokalign.query,
    "op13_hard_negatives": hardneg.query,
}

ORACLE_SQL = {
    "op2_ngram_jaccard_join": ngram_join.SQL,
    "op3_benchmark_decontamination": decontam.SQL,
    "op7_source_mixing": mixing.SQL,
    "op8_url_filters": url_filter.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_nearest_neighbours": ann.SQL,
    "op11_embedding_near_dedup": hnsw.SQL,
    "op13_hard_negatives": hardneg.SQL,
}
