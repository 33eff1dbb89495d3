"""Collects the QUERIES and SQL of the core modules."""

from __future__ import annotations

from noteflow.operators import answering, evaluation, extraction, graph, hybrid, incremental, learned, lexical, normalization, notes, paths, planning, quality, reasoning, references, relating, retrieval, selection, vectors

MODULES = [references, notes, graph, lexical, vectors, evaluation, incremental, extraction, normalization, selection, reasoning, retrieval, learned, hybrid, quality, answering, planning, paths, relating]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
