"""Queries and SQL of this subpackage, for the registry at the repository top."""

from __future__ import annotations

import importlib

#: query name -> module that holds a function of that name (and perhaps ORACLE)
OPERATORS = {
    "op1_pii": "pii",
    "op8_byte_bpe": "bpe",
    "op9_best_fit_packing": "packing",
    "op10_quality_rules": "quality_rules",
    "op2_chat_formatting": "chat",
    "op3_quality_classifier": "quality_model",
    "op4_simhash_near_dedup": "simhash",
    "op5_warc": "warc",
    "op6_html_extraction": "html_text",
    "op7_exact_dedup": "exact_dedup",
}


def _module(name: str):
    return importlib.import_module(f".{OPERATORS[name]}", __package__)


def queries() -> dict:
    out = {name: getattr(_module(name), name) for name in OPERATORS}
    import corpus_pipeline

    out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {name: sql for name in OPERATORS if (sql := getattr(_module(name), "ORACLE", None))}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
