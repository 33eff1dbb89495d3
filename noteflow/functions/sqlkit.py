"""Pieces of DuckDB SQL that the checks of many queries share. They are written for themselves, not made from the plans."""

from __future__ import annotations

BLANK = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '', true)"
ENTS = "list_filter(coalesce(entities, []::VARCHAR[]), lambda e: NOT " + BLANK.format("e") + ")"
WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+')), lambda w: w <> '')"
SPLIT = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda w: w <> '')"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
MASKED = "regexp_replace(coalesce({0}, ''), '[^\\x00-\\x7F\\p{{P}}\\p{{Z}}\\p{{S}}]', '_', 'g')"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([。！？.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
NOTES = """notes AS (SELECT * FROM (SELECT * FROM atomic_notes QUALIFY row_number() OVER
  (PARTITION BY note_id ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL)"""
RELATIONS = """rel AS (SELECT relation_id, source_id, target_id, lower(relation_type) AS relation_type, coalesce(weight, 0.0) AS weight, reasoning_value, extracted_at
  FROM (SELECT * FROM note_relations QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY ingested_at DESC NULLS LAST) = 1)
  WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id)"""
QA = "qa AS (SELECT * FROM qa_results QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
PASSAGES = "pa AS (SELECT * FROM (SELECT * FROM paragraphs QUALIFY row_number() OVER (PARTITION BY item_id, idx ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL)"


def quoted(words: list[str]) -> str:
    """A list of texts."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) - {n} > 0 THEN {n} / (len({a}) + len({b}) - {n})::DOUBLE ELSE 0.0::DOUBLE END"


def without(words: str, stop: list[str]) -> str:
    return f"list_filter({words}, lambda w: NOT list_contains({quoted(stop)}, w))"


def found(text: str, pattern: str, group: int = 0) -> str:
    """All matches of a pattern in masked text, each once."""
    return f"list_distinct(regexp_extract_all({MASKED.format(text)}, '{pattern}', {group}))"
