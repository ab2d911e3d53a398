"""The queries of this package by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

import importlib

#: Modules with their query functions; a module's own SQL is named OPn_SQL.
MODULES = {
    "quality_rules": "op1_quality_rules",
    "secret_scan": "op2_secret_scan",
    "ann_mih": "op3_ann_mih",
    "token_store": "op6_token_store",
    "language_id": "op7_language_id",
    "pfair_mix": "op4_pfair_mix",
    "piece_codec": "op5_piece_codec",
    "html_extract": "op9_html_extraction",
    "chat_format": "op8_chat_formatting",
    "jaccard_join": "op10_jaccard_join",
    "merkle_manifest": "op11_merkle_manifest",
    "phrase_mining": "op12_phrase_mining",
    "warc_store": "op13_warc_store",
}


def queries() -> dict:
    return {fn: getattr(importlib.import_module(f"tessella.llm.{m}"), fn) for m, fn in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {fn: getattr(importlib.import_module(f"tessella.llm.{m}"), f"{fn.split('_')[0].upper()}_SQL", None) for m, fn in MODULES.items()}
    return {k: v for k, v in found.items() if v}
