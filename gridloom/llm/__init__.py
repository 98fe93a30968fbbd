"""Operators of a training-data pipeline: tokenizing, deduplication, filtering, mixing and search."""

from __future__ import annotations

from gridloom.llm import bpe, collocations, html_text, lexical_search, mixing, neardup_vectors, quality, secret_scan, simhash, substring_dedup, token_counts, toxicity, vector_search

_MODULES = (bpe, neardup_vectors, vector_search, html_text, simhash, toxicity, quality, secret_scan, mixing, substring_dedup, token_counts, collocations, lexical_search)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
