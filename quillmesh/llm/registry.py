"""The queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from quillmesh.llm import alignment, best_fit, bpe, hard_negatives, line_dedup, packing, quality, secret_scan, sharding, simhash, substring_dedup, vector_search

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_packing": packing.query,
    "op3_line_dedup": line_dedup.query,
    "op4_simhash": simhash.query,
    "op5_secret_scan": secret_scan.query,
    "op6_top_k": vector_search.top_k_query,
    "op7_bpe": bpe.query,
    "op8_nearest": vector_search.nearest_query,
    "op9_sharding": sharding.query,
    "op10_quality": quality.query,
    "op11_alignment": alignment.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_best_fit": best_fit.query,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op6_top_k": vector_search.TOP_K_SQL,
    "op9_sharding": sharding.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
