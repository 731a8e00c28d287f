"""Queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from . import alignment, exact_dedup, language_id, license_scan, line_dedup, mixing, near_dedup, ngram_join, packing, pii, topk, url_filter, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_threshold_topk": topk.op2_threshold_topk,
    "op3_power_of_two_packing": packing.op3_power_of_two_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_feistel_pseudonyms": pii.op5_feistel_pseudonyms,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_ngram_jaccard_join": ngram_join.op12_ngram_jaccard_join,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_threshold_topk": topk.OP2_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_license_scan": license_scan.OP7_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op12_ngram_jaccard_join": ngram_join.OP12_SQL,
}
