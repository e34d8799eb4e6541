"""Registered queries of this subpackage: name -> (query, SQL or None)."""
from __future__ import annotations

import importlib

#: Modules of this package that register queries.
MODULES = ["q_tokens", "q_warc", "q_quality", "q_urls", "q_pii", "q_packing", "q_nearest", "q_jaccard", "q_dedup", "q_mix", "q_repair", "q_resample", "q_rules"]


def load() -> dict:
    found = {}
    for name in MODULES:
        found.update(importlib.import_module(f"veiltab.llm.{name}").QUERIES)
    return found
