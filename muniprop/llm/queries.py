"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from muniprop.llm import (
    centroid_clustering,
    chat_format,
    decontamination,
    exact_dedup,
    html_extraction,
    importance_resampling,
    language_id,
    quality_rules,
    simhash_dedup,
    source_mixing,
    suffix_dedup,
    token_store,
    url_filters,
)
from muniprop.llm.common import Query

QUERIES: dict[str, Query] = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_token_store": token_store.op4_token_store,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_source_mixing": source_mixing.op6_source_mixing,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_language_id": language_id.op10_language_id,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}
ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.OP1_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_source_mixing": source_mixing.OP6_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_centroid_clustering": centroid_clustering.OP12_SQL,
    "op13_importance_resampling": importance_resampling.OP13_SQL,
}
