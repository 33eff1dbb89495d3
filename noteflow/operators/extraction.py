"""Extraction from texts: entities, predicates, facts, triples, types, JSON in model output, note checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import table
from noteflow.operators.lexical import _MASK, NO_NAMES
from noteflow.operators.notes import SQL_NOTES, notes

# Patterns that are applied to masked text (see lexical._MASK), and words.
PATTERNS = {
    "name": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b",
    "acronym": r"\b[A-Z]{2,6}\b",
    "year": r"\b(?:1[5-9]|20)[0-9][0-9]\b",
    "number": r"\b[0-9]+(?:[.,][0-9]+)*\b",
    "organisation": r"\b(?:[A-Z][a-z]+ )+(?:Company|Society|University|Museum|Press|Trust|Foundation|Survey|Bank)\b",
    "of_organisation": r"\b(?:University|College|Bank|Museum|Society) of [A-Z][a-z]+\b",
}
PREDICATES = {
    "founded": "found", "established": "found", "created": "create", "written": "write", "wrote": "write", "born": "be_born", "died": "die", "located": "be_located",
    "moved": "move", "built": "build", "received": "receive", "succeeded": "succeed", "published": "publish", "sold": "sell", "opened": "open", "rebuilt": "build",
    "measured": "measure", "employs": "employ", "lies": "be_located", "worked": "work", "painted": "paint", "left": "leave", "returned": "return", "drew": "draw",
}
PERSON_HINTS = ["dr", "prof", "mr", "mrs", "ms", "sir"]
NO_PERSONS = ["university", "society", "company", "museum", "bank", "garden", "institute", "association", "airport", "school", "department", "trust", "press", "foundation", "survey", "college", "sons"]
DANGLING = r"\b(?:he|she|it|they|this|that)\b"
MADE_UP = r"(?i)\b(?:fake|fictional|made-up|invented)\b|\b[A-Z][a-z]*X{2,}\b|\b[A-Z][a-z]*[0-9]{3,}\b"


def masked(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _MASK, "_")


def found(c: Column, pattern: str) -> Column:
    """All matches in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(masked(c), F.lit(pattern), F.lit(0)))


def facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, fact: names, acronyms, years, numbers and organisations of a text, each once per kind."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), found(F.col(text), p).alias("f")) for k, p in PATTERNS.items()])
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.kind", F.explode("x.f").alias("fact")).where(~F.col("fact").isin(NO_NAMES))


def predicates(c: Column) -> Column:
    """The normalized predicates of a text, in the order of their first words, each once."""
    lexicon = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(tx.tokens(c), lambda w: lexicon[w]), lambda p: p.isNotNull()))


def triples(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, subject, predicate, object: a name, a word of the lexicon and what follows it up to a mark, per sentence."""
    words = "|".join(sorted(PREDICATES))
    pattern = rf"([A-Z][\w ]*?) (?:was |is |has |had )?({words}) ([^.,;:!?]+)"
    s = df.select(key, F.explode(F.transform(tx.sentences(F.col(text)), lambda x: F.regexp_replace(x, _MASK, "_"))).alias("s"))
    part = lambda i: F.regexp_extract("s", pattern, i)
    lexicon = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    return s.where(part(2) != "").select(key, F.trim(part(1)).alias("subject"), lexicon[part(2)].alias("predicate"), F.trim(part(3)).alias("object"))


def entity_kind(c: Column) -> Column:
    """person, organisation or other, by words and titles of a name; two or three capitalised words are a person."""
    low = tx.tokens(c)
    org = F.arrays_overlap(low, F.array(*[F.lit(w) for w in NO_PERSONS]))
    title = F.arrays_overlap(F.slice(low, 1, 1), F.array(*[F.lit(w) for w in PERSON_HINTS]))
    shaped = masked(c).rlike(r"^[A-Z_][\w'\-]+( [A-Z]\.?)?( [A-Z_][\w'\-]+){1,2}$")
    return F.when(org, "organisation").when(title | shaped, "person").otherwise("other")


def note_issues(df: DataFrame) -> DataFrame:
    """note_id, issues: content_too_short (under 20 characters), no_entities_identified, incomplete_content (dots three times),
    incomplete_sentence (no end mark), not_in_content (an entity the content lacks), likely_fabricated (a made-up form of
    name), trailing_dots, excessive_pronouns (over a tenth of the words)."""
    t, w = F.coalesce("content", F.lit("")), F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda x: x != "")
    ents = F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~tx.blank(e))
    flags = F.array(
        F.when(F.char_length(F.trim(t)) < 20, "content_too_short"), F.when(F.size(ents) == 0, "no_entities_identified"), F.when(F.size(F.split(t, r"\.\.\.")) > 3, "incomplete_content"),
        F.when(~F.trim(t).rlike(r"[.!?]$"), "incomplete_sentence"), F.when(F.exists(ents, lambda e: ~F.contains(F.lower(t), F.lower(e))), "not_in_content"),
        F.when(F.exists(ents, lambda e: masked(e).rlike(MADE_UP)), "likely_fabricated"), F.when(t.endswith("..."), "trailing_dots"),
        F.when(F.size(F.regexp_extract_all(F.lower(masked(F.col("content"))), F.lit(DANGLING), F.lit(0))) > 0.1 * F.size(w), "excessive_pronouns"),
    )
    return df.select("note_id", F.array_join(F.array_compact(flags), ",").alias("issues"))


def context_breaks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence_no of sentences that share no capitalised word with the one before, both of more than five words."""
    rows = df.select(key, tx.sentences(F.col(text)).alias("s"))
    names = F.transform("s", lambda x: F.struct(F.array_distinct(F.regexp_extract_all(F.regexp_replace(x, _MASK, "_"), F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))).alias("n"), (F.size(tx.tokens(x)) > 5).alias("long")))
    rows = rows.select(key, names.alias("n")).where(F.size("n") > 1)
    at = F.filter(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.element_at("n", i)["long"] & F.element_at("n", i + 1)["long"] & ~F.arrays_overlap(F.element_at("n", i)["n"], F.element_at("n", i + 1)["n"]))
    return rows.select(key, F.explode(at).alias("sentence_no"))


def shorten(c: Column, limit: int = 1000) -> Column:
    """The first `limit` characters, back to the last full stop if that keeps 70 % of them."""
    t = F.coalesce(c, F.lit(""))
    cut = F.left(t, F.lit(limit))
    dot = F.char_length(cut) - F.locate(".", F.reverse(cut)) + 1
    return F.when(F.char_length(t) <= limit, t).when((F.locate(".", F.reverse(cut)) > 0) & (dot >= 0.7 * limit), F.left(cut, dot)).otherwise(cut)


def json_object(c: Column) -> Column:
    """The JSON object in a model's output: as it is, inside a code fence, or from the first to the last brace; null if
    none of them is JSON."""
    tries = [F.trim(c), F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when(t.startswith("{") & F.json_object_keys(t).isNotNull(), t) for t in tries])


def answer_of_output(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, answer, is_json: the `answer` of the JSON in a model's output, else the output itself, trimmed."""
    j = json_object(F.col(raw))
    return df.select(key, F.coalesce(F.get_json_object(j, "$.answer"), F.trim(raw)).alias("answer"), j.isNotNull().alias("is_json"))


def stable_ids(df: DataFrame) -> DataFrame:
    """note_id, stable_id: file and chunk with the note's ordinal in it, else the start of the md5 of its content."""
    by_file = F.format_string("%s_%06d_%s", F.coalesce("source_info.file_name", F.lit("")), F.coalesce("chunk_index", F.lit(0)), F.left(F.md5(F.coalesce("content", F.lit(""))), F.lit(8)))
    return df.select("note_id", F.when(F.col("source_info.file_name").isNotNull(), by_file).otherwise(F.left(F.md5(F.left(F.coalesce("content", F.lit("")), F.lit(100))), F.lit(8))).alias("stable_id"))


def rule_notes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, content, entities: a note by rule where no model writes one - the first sentence, at most 200 characters, with
    an end mark, and the names in it. Blank texts give none."""
    first = F.left(F.get(tx.sentences(F.col(text)), F.lit(0)), F.lit(200))
    ended = F.when(first.rlike(r"[.!?。！？]$"), first).otherwise(F.concat(first, F.lit(".")))
    return df.where(~tx.blank(F.col(text))).select(key, ended.alias("content")).withColumn("entities", F.array_join(found(F.col("content"), PATTERNS["name"]), "|"))


def _n(make):
    return lambda s, d: make(notes(s, d))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


QUERIES = {
    "note_facts": _n(lambda n: facts(n, "note_id", "content")),
    "document_fact_counts": lambda s, d: facts(_docs(s, d), "doc_id", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fact").alias("different")),
    "note_predicates": _n(lambda n: n.select("note_id", F.array_join(predicates(F.col("content")), ",").alias("predicates"))),
    "note_triples": _n(lambda n: triples(n, "note_id", "content")),
    "entity_kinds": _n(lambda n: n.select(F.explode("entities").alias("e")).where(~tx.blank(F.col("e"))).groupBy(F.col("e").alias("entity"), entity_kind(F.col("e")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))),
    "note_issues": _n(note_issues),
    "document_context_breaks": lambda s, d: context_breaks(_docs(s, d), "doc_id", "text"),
    "document_shortened": lambda s, d: _docs(s, d).select("doc_id", F.char_length(shorten(F.col("text"))).alias("length"), F.md5(shorten(F.col("text"))).alias("digest")),
    "answer_json": lambda s, d: answer_of_output(table(s, d, "qa_results").select("id", "predicted_answer").distinct(), "id", "predicted_answer"),
    "note_stable_ids": _n(stable_ids),
    "rule_notes": lambda s, d: rule_notes(_docs(s, d), "doc_id", "text"),
}

_MASKED = "regexp_replace(coalesce({0}, ''), '[^\\x00-\\x7F\\p{{P}}\\p{{Z}}\\p{{S}}]', '_', 'g')"
_BLANK = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '', true)"
_SENT = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([。！？.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_NO = ", ".join(f"'{w}'" for w in NO_NAMES)
_W = f"WITH {SQL_NOTES}"
_LEX = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in PREDICATES.items()) + "}"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _facts_sql(table_: str, key: str, text: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, '{k}' AS kind, unnest(list_distinct(regexp_extract_all({_MASKED.format(text)}, '{p}'))) AS fact FROM {table_}" for k, p in PATTERNS.items())
    return f"f AS (SELECT * FROM ({parts}) WHERE fact NOT IN ({_NO}))"


_TRIPLE = "([A-Z][\\w ]*?) (?:was |is |has |had )?(" + "|".join(sorted(PREDICATES)) + ") ([^.,;:!?]+)"
SQL = {
    "note_facts": f"{_W}, {_facts_sql('notes', 'note_id', 'content')} SELECT * FROM f",
    "document_fact_counts": f"WITH {_facts_sql('documents', 'doc_id', 'text')} SELECT kind, count(*) AS n, count(DISTINCT fact) AS different FROM f GROUP BY kind",
    "note_predicates": f"""{_W}, p AS (SELECT note_id, list_filter(list_transform({_TOK.format('content')}, lambda w: ({_LEX})[w]), lambda p: p IS NOT NULL) AS p FROM notes)
SELECT note_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS predicates FROM p""",
    "note_triples": f"""{_W}, s AS (SELECT note_id, {_MASKED.format('s')} AS s FROM (SELECT note_id, unnest({_SENT.format('content')}) AS s FROM notes)),
t AS (SELECT note_id, regexp_extract(s, '{_TRIPLE}', 1) AS a, regexp_extract(s, '{_TRIPLE}', 2) AS p, regexp_extract(s, '{_TRIPLE}', 3) AS o FROM s)
SELECT note_id, trim(a) AS subject, ({_LEX})[p] AS predicate, trim(o) AS object FROM t WHERE p <> ''""",
    "entity_kinds": f"""{_W}, e AS (SELECT unnest(entities) AS e FROM notes), c AS (SELECT e AS entity, CASE WHEN list_has_any({_TOK.format('e')}, {_LIST(NO_PERSONS)}) THEN 'organisation'
  WHEN list_has_any({_TOK.format('e')}[1:1], {_LIST(PERSON_HINTS)}) OR regexp_matches({_MASKED.format('e')}, '^[A-Z_][\\w''\\-]+( [A-Z]\\.?)?( [A-Z_][\\w''\\-]+){{1,2}}$') THEN 'person' ELSE 'other' END AS kind FROM e WHERE NOT {_BLANK.format('e')})
SELECT entity, kind, count(*) AS n FROM c GROUP BY ALL""",
    "note_issues": f"""{_W}, t AS (SELECT note_id, coalesce(content, '') AS t, {_MASKED.format('content')} AS m, list_filter(coalesce(entities, []::VARCHAR[]), lambda e: NOT {_BLANK.format('e')}) AS e FROM notes)
SELECT note_id, concat_ws(',', CASE WHEN length(trim(t)) < 20 THEN 'content_too_short' END, CASE WHEN len(e) = 0 THEN 'no_entities_identified' END, CASE WHEN len(string_split(t, '...')) > 3 THEN 'incomplete_content' END,
  CASE WHEN NOT regexp_matches(trim(t), '[.!?]$') THEN 'incomplete_sentence' END, CASE WHEN len(list_filter(e, lambda x: NOT contains(lower(t), lower(x)))) > 0 THEN 'not_in_content' END,
  CASE WHEN len(list_filter(e, lambda x: regexp_matches({_MASKED.format('x')}, '{MADE_UP}'))) > 0 THEN 'likely_fabricated' END, CASE WHEN ends_with(t, '...') THEN 'trailing_dots' END,
  CASE WHEN len(regexp_extract_all(lower(m), '{DANGLING}')) > 0.1 * len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) THEN 'excessive_pronouns' END) AS issues FROM t""",
    "document_context_breaks": f"""WITH s AS (SELECT doc_id, {_SENT.format('text')} AS s FROM documents), n AS (SELECT doc_id, list_transform(s, lambda x: list_distinct(regexp_extract_all({_MASKED.format('x')}, '\\b[A-Z][a-z]+\\b'))) AS n, list_transform(s, lambda x: len({_TOK.format('x')}) > 5) AS l FROM s),
i AS (SELECT doc_id, n, l, unnest(range(1, len(n))) AS i FROM n WHERE len(n) > 1) SELECT doc_id, i::INTEGER AS sentence_no FROM i WHERE l[i] AND l[i + 1] AND NOT list_has_any(n[i], n[i + 1])""",
    "document_shortened": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, left(coalesce(text, ''), 1000) AS c FROM documents), p AS (SELECT *, strpos(reverse(c), '.') AS q FROM t),
s AS (SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t WHEN q > 0 AND length(c) - q + 1 >= 700 THEN left(c, length(c) - q + 1) ELSE c END AS s FROM p) SELECT doc_id, length(s)::INTEGER AS length, md5(s) AS digest FROM s""",
    "note_stable_ids": f"""{_W} SELECT note_id, CASE WHEN source_info.file_name IS NOT NULL THEN source_info.file_name || '_' || lpad(coalesce(chunk_index, 0)::VARCHAR, 6, '0') || '_' || left(md5(coalesce(content, '')), 8) ELSE left(md5(left(coalesce(content, ''), 100)), 8) END AS stable_id FROM notes""",
    "rule_notes": f"""WITH f AS (SELECT doc_id, left(({_SENT.format('text')})[1], 200) AS f FROM documents WHERE NOT {_BLANK.format('text')}), c AS (SELECT doc_id, CASE WHEN regexp_matches(f, '[.!?。！？]$') THEN f ELSE f || '.' END AS content FROM f),
e AS (SELECT doc_id, content, regexp_extract_all({_MASKED.format('content')}, '{PATTERNS['name']}') AS e FROM c) SELECT doc_id, content, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '|') AS entities FROM e""",
}
