"""Registered queries of this folder and their DuckDB statements."""

from __future__ import annotations

from riskloom.llm import bpe, jaccard, langid, lines, lzprint, mixing, pii, quality, ranking, runs, sharding, warc, zonemap

QUERIES = {
    "op1_document_fingerprints": lzprint.op1_document_fingerprints,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_warc": warc.op3_warc,
    "op4_sharding": sharding.op4_sharding,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_language_id": langid.op7_language_id,
    "op8_bpe_encoding_and_decoding": bpe.op8_bpe_encoding_and_decoding,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_mixing_sources_to_target_weights": mixing.op10_mixing_sources_to_target_weights,
    "op11_periodic_run_detection": runs.op11_periodic_run_detection,
    "op12_centroid_clustering": zonemap.op12_centroid_clustering,
    "op13_quality_classifier": ranking.op13_quality_classifier,
}

SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op5_line_dedup": lines.SQL,
    "op12_centroid_clustering": zonemap.SQL,
}
