"""The queries of the ten operators and the SQL to hold them against."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_quality": "quality",
    "op3_chat_formatting": "chat",
    "op4_best_fit_packing": "packing",
    "op5_toxicity": "toxicity",
    "op6_chroma_fingerprints": "fingerprint",
    "op7_token_counts": "token_counts",
    "op8_line_dedup": "line_dedup",
    "op9_binary_records": "records",
    "op10_jaccard_join": "jaccard_join",
}

_loaded = {name: import_module(f".{module}", __package__) for name, module in MODULES.items()}
QUERIES = {name: m.query for name, m in _loaded.items()}
#: Operator 2 with its model in shards, as models beyond ``HELD_NGRAMS`` are scored: the same rows.
QUERIES["quality_in_shards"] = _loaded["op2_quality"].query_in_shards
ORACLES = {name: m.ORACLE for name, m in _loaded.items() if getattr(m, "ORACLE", None)}
