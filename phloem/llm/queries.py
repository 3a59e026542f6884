"""Queries of the llm operators and their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and SQL.
_PARTS = ("q_groups", "q_boilerplate", "q_mojibake", "q_markup", "q_lookalike", "q_sitelines", "q_knn", "q_mix_pack")

QUERIES: dict = {}
SQL: dict = {}
for _name in _PARTS:
    _m = importlib.import_module(f"phloem.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
