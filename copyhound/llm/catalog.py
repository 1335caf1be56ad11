"""The queries of this folder, one `opN_<name>` for each operator, and their SQL where DuckDB can express them."""

from __future__ import annotations

import importlib

_MODULES = ["op1_jaccard_join", "op2_secrets", "op3_token_files", "op4_rule_cascade", "op5_language", "op6_suffix_tree", "op7_itq_neardup", "op8_pieces", "op9_packing", "op10_line_crf", "op11_prefix_trie", "op12_contamination", "op13_spelling"]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"copyhound.llm.{name}"), name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in _MODULES:
        sql = getattr(importlib.import_module(f"copyhound.llm.{name}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
