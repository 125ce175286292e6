"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

import importlib

#: query name -> module of this package; a query is the function of that name in it.
MODULES = {
    "op1_chat_format": "chat",
    "op2_token_counts": "tokens",
    "op3_secret_scan": "secrets",
    "op4_simhash_near_dedup": "simhash",
    "op5_language_id": "langid",
    "op6_bpe_codec": "codec",
    "op7_lm_score": "lm",
    "op8_quality_rules": "quality",
    "op9_decontamination": "decontam",
    "op10_toxicity": "toxicity",
    "op11_best_fit_packing": "packing",
    "op12_fill_in_middle": "fim",
    "op13_prefix_trie": "trie",
}
#: query name -> attribute that holds its SQL.
SQL = {"op1_chat_format": "OP1_SQL", "op12_fill_in_middle": "OP12_SQL", "op13_prefix_trie": "OP13_SQL"}


def _module(name: str):
    return importlib.import_module(f"kinmesh.llm.{MODULES[name]}")


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(_module(name), name) for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_module(name), attribute) for name, attribute in SQL.items()}
