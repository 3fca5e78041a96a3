"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import part_trees, relational, search, texts

MODULES = [relational, texts, search, part_trees]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
