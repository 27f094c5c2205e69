"""The registered queries and their SQL."""

from __future__ import annotations

from . import conditions, evaluation, layouts, networks, passages, provisions, ranking, structures, texts

_PARTS = (ranking, texts, structures, evaluation, passages, provisions, conditions, networks, layouts)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
QUERIES = dict(sorted(QUERIES.items()))
