"""Queries and SQL of the problems on training data."""

from __future__ import annotations

from pairlens.llm import encode, group_splits, leaks, overlap, raking, truncation, unify

_PARTS = (truncation, raking, group_splits, overlap, encode, leaks, unify)
QUERIES = {name: f for m in _PARTS for name, f in m.QUERIES.items()}
SQL = {name: s for m in _PARTS for name, s in m.SQL.items()}
