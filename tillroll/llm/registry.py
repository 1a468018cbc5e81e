"""The queries of this subpackage and the SQL that states their results, by name."""
from __future__ import annotations

from importlib import import_module

MODULES = [
    "op1_exact_dedup",
    "op2_warc",
    "op3_ngram_join",
    "op4_chat_format",
    "op5_toxicity",
    "op6_decontamination",
    "op7_token_count",
    "op8_pii",
    "op9_line_dedup",
    "op10_packing",
    "op11_conversation_repair",
    "op12_source_divergence",
    "op13_embedding_neardup",
]

QUERIES, SQL = {}, {}
for name in MODULES:
    part = import_module(f"tillroll.llm.{name}")
    QUERIES[name] = part.query
    if getattr(part, "ORACLE_SQL", None):
        SQL[name] = part.ORACLE_SQL
