"""Queries and SQL of the corpus operators, for the registry at the top of the repository."""

from __future__ import annotations

import importlib

#: Query name and the module that holds the function of that name.
_QUERIES = {
    "op1_byte_bpe": "bpe",
    "op2_simhash": "simhash",
    "op3_toxicity": "toxicity",
    "op4_language_id": "langid",
    "op5_gif_media": "media",
    "op6_exact_dedup": "exact",
    "op7_preference_format": "chat",
    "op8_content_store": "store",
    "op9_packing": "packing",
    "op10_secret_scan": "secretscan",
    "op11_prefix_trie": "trie",
    "op12_sentencepiece": "pieces",
    "op13_resample": "resample",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidemark.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"tidemark.llm.{module}"), "ORACLE_SQL", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
