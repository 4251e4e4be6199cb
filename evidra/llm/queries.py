"""Queries of the numbered operators and the SQL for those that SQL can express."""

from __future__ import annotations

from . import op01_lm, op02_neighbours, op03_media, op04_language, op05_pii, op06_packing, op07_mixing, op08_counts, op09_urls, op10_dedup, op11_negatives, op12_audit, op13_secrets

QUERIES = {
    "op1_lm_scoring": op01_lm.op1_lm_scoring,
    "op2_neighbours": op02_neighbours.op2_neighbours,
    "op3_telephony": op03_media.op3_telephony,
    "op4_language_id": op04_language.op4_language_id,
    "op5_pii": op05_pii.op5_pii,
    "op6_packing": op06_packing.op6_packing,
    "op7_mix_sources": op07_mixing.op7_mix_sources,
    "op8_token_counts": op08_counts.op8_token_counts,
    "op9_url_filters": op09_urls.op9_url_filters,
    "op10_near_duplicates": op10_dedup.op10_near_duplicates,
    "op11_hard_negatives": op11_negatives.op11_hard_negatives,
    "op12_filter_audit": op12_audit.op12_filter_audit,
    "op13_secrets": op13_secrets.op13_secrets,
}
ORACLES = {"op9_url_filters": op09_urls.ORACLE, "op11_hard_negatives": op11_negatives.ORACLE, "op12_filter_audit": op12_audit.ORACLE}
