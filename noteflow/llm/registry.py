"""Collects the QUERIES and SQL of this subpackage."""

from __future__ import annotations

from noteflow.llm import names, neighbours, packing, pairs, residue, splitting, tokens

MODULES = [tokens, packing, neighbours, residue, pairs, names, splitting]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
