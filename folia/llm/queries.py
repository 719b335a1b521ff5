"""Registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from . import decontamination, html_text, licenses, ngram_join, packing, pii, quality_rules, suffix_dedup, tokens, toxicity
from .common import table


def _documents(query):
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": _documents(quality_rules.query),
    "op2_best_fit_packing": _documents(packing.query),
    "op3_toxicity_chain": toxicity.query,
    "op4_token_counts": _documents(tokens.query),
    "op5_suffix_dedup": _documents(suffix_dedup.query),
    "op6_ngram_jaccard_join": _documents(ngram_join.query),
    "op7_license_scan": _documents(licenses.query),
    "op7_license_scan_published": _documents(licenses.query_published),
    "op8_pii_surrogates": _documents(pii.query),
    "op9_html_extraction": html_text.query,
    "op10_benchmark_decontamination": decontamination.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op7_license_scan": licenses.ORACLE,
}
