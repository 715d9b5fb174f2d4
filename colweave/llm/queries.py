"""The queries of these operators and their DuckDB SQL."""

from __future__ import annotations

from colweave.llm import decontamination, fill_in_middle, html_text, language, licenses, range_join, sentencepiece_lattice, sharding, simhash, suffix_dedup, token_counts, toxicity, whitening

QUERIES = {
    "op1_language_id": language.query,
    "op2_sentencepiece_encoding": sentencepiece_lattice.query,
    "op3_benchmark_decontamination": decontamination.query,
    "op4_sharding": sharding.query,
    "op5_html_extraction": html_text.query,
    "op6_embedding_near_dedup": range_join.query,
    "op7_token_counts": token_counts.query,
    "op8_toxicity": toxicity.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_license_scans": licenses.query,
    "op11_suffix_array_dedup": suffix_dedup.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_embedding_whitening": whitening.query,
}
ORACLES = {
    "op3_benchmark_decontamination": decontamination.ORACLE,
    "op6_embedding_near_dedup": range_join.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
