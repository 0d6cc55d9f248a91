"""The queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline

from . import chat, hnsw, licences, mixing, pii, quality, repetition, rtree, simhash, tokens, warc, whitening, winnowing

QUERIES = {
    "op1_licence_scan": licences.op1_licence_scan,
    "op2_warc_archive": warc.op2_warc_archive,
    "op3_quality_scores": quality.op3_quality_scores,
    "op4_chat_format": chat.op4_chat_format,
    "op5_mixture": mixing.op5_mixture,
    "op6_simhash_near_duplicates": simhash.op6_simhash_near_duplicates,
    "op7_personal_data": pii.op7_personal_data,
    "op8_repetition_rules": repetition.op8_repetition_rules,
    "op9_token_files": tokens.op9_token_files,
    "op10_decontamination": winnowing.op10_decontamination,
    "op11_hnsw_neighbours": hnsw.op11_hnsw_neighbours,
    "op12_rtree_hard_negatives": rtree.op12_rtree_hard_negatives,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op2_warc_archive": warc.SQL, "op4_chat_format": chat.SQL, "op10_decontamination": winnowing.SQL, "op12_rtree_hard_negatives": rtree.SQL}


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
