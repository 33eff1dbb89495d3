"""Queries taken apart and model output taken in: sub-questions, namespaces, notes and answers in JSON, cited spans, hints;
and what a set of passages covers of what a question requires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import sqlkit as sk
from noteflow.functions import text as tx
from noteflow.operators.evaluation import FORBIDDEN, items, passages
from noteflow.operators.extraction import masked
from noteflow.operators.hybrid import candidates
from noteflow.operators.notes import notes

# What joins the parts of a question, in order of preference; words that begin questions; words without weight.
CONJUNCTIONS = [r"\s+(?:and|und|et)\s+", r"\s+(?:or|oder|ou)\s+", r"，|、", r"\s+y\s+|\s+o\s+", r"\s*&\s*"]
BEGINNINGS = ["what", "how", "why", "when", "where", "who", "which"]
REQUIRED_STOPS = "the is are was were who what where when how".split()
NAMES, WORDS_CAPITAL = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", r"\b[A-Z][a-z]*\b"
NOTE_FIELDS = "array<struct<text: string, sent_count: int, salience: double, source_sent_ids: array<string>, entities: array<string>>>"


def conjunction_parts(q: DataFrame) -> DataFrame:
    """id, part_no, part, priority: a question cut by the first conjunction that cuts it; the priority is one over the number
    of parts. Questions that none cuts stay whole."""
    t = F.coalesce("question", F.lit(""))
    cuts = [F.split(t, p) for p in CONJUNCTIONS]
    first = F.coalesce(*[F.when(F.size(c) > 1, c) for c in cuts], F.array(t))
    good = F.array_distinct(F.filter(F.transform(first, lambda x: F.trim(x)), lambda x: x != ""))
    return q.select("id", F.size(first).alias("n"), F.posexplode(good).alias("part_no", "part")).select("id", "part_no", "part", F.round(1 / F.col("n"), 6).alias("priority"))


def entity_parts(q: DataFrame) -> DataFrame:
    """id, entity, part: for each name of a question the question about that name alone."""
    names = F.array_distinct(F.regexp_extract_all(masked(F.col("question")), F.lit(NAMES), F.lit(0)))
    return q.select("id", F.explode(names).alias("entity")).select("id", "entity", F.concat(F.lit("about "), "entity").alias("part"))


def is_question(c: Column) -> Column:
    """Five characters or more that end with a question mark or begin with a question word."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.char_length(t) >= 5) & (t.endswith("?") | F.lower(t).rlike("^(" + "|".join(BEGINNINGS) + ")"))


def valid_parts(parts: DataFrame, q: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """id, parts: the first `most` parts that are questions, if there are `least`; else the question itself. parts: id, part_no, part."""
    good = parts.where(is_question(F.col("part"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part_no", "part"))).alias("p"))
    own = F.slice(F.transform("p", lambda x: x["part"]), 1, most)
    return q.join(good, "id", "left").select("id", F.array_join(F.when(F.size("p") >= least, own).otherwise(F.array(F.coalesce("question", F.lit("")))), " | ").alias("parts"))


def listed_questions(c: Column) -> Column:
    """Questions that a model wrote in quotes, as a numbered list or with dashes, each once, five at most."""
    every = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r'"([^"]*\?)"', r"[0-9]+\.\s*([^\n]*\?)", r"-\s*([^\n]*\?)")]
    return F.slice(F.filter(F.transform(F.concat(*every), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)


def in_namespace(path: Column, name: Column, dataset: str, part: str) -> Column:
    """True if the path (the file name where there is none) holds the names of data set and part, letter case and kind of
    slash aside; false without either."""
    p = F.lower(F.replace(F.when(F.coalesce(path, F.lit("")) != "", path).otherwise(F.coalesce(name, F.lit(""))), F.lit("\\"), F.lit("/")))
    return (p != "") & F.contains(p, F.lit(dataset.lower())) & F.contains(p, F.lit(part.lower()))


def namespace_summary(n: DataFrame, dataset: str, part: str) -> DataFrame:
    """total_notes, matching_notes, match_rate, has_matches of a namespace; one row."""
    own = n.select(F.coalesce(in_namespace(F.col("source_info.file_path"), F.col("source_info.file_name"), dataset, part), F.lit(False)).alias("m"))
    t = own.agg(F.count(F.lit(1)).alias("total_notes"), F.count_if("m").alias("matching_notes"))
    return t.select("total_notes", "matching_notes", F.round(F.when(F.col("total_notes") > 0, F.col("matching_notes") / F.col("total_notes")).otherwise(0.0), 6).alias("match_rate"), (F.col("matching_notes") > 0).alias("has_matches"))


def require_namespace(n: DataFrame, dataset: str, part: str) -> DataFrame:
    """The notes of a namespace; raises ValueError if there are none."""
    own = n.where(in_namespace(F.col("source_info.file_path"), F.col("source_info.file_name"), dataset, part))
    if own.isEmpty():
        raise ValueError(f"no notes in {dataset}/{part}")
    return own


def parsed_notes(df: DataFrame, key: str, raw: str, sentinel: str = "~") -> DataFrame:
    """key, state, notes: the notes in a model's output - a JSON array, a JSON object, the array at the end of a text or the
    object inside one. state: empty (nothing, the sentinel or an empty array), notes, or failed (notes is null)."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    tail, inner = F.regexp_extract(s, r"(?s)(\[.*\])$", 1), F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    as_array = lambda c: F.when(c.startswith("[") & F.json_array_length(c).isNotNull(), c)
    as_object = lambda c: F.when(c.startswith("{") & F.json_object_keys(c).isNotNull(), F.concat(F.lit("["), c, F.lit("]")))
    json = F.coalesce(as_array(s), as_object(s), as_array(tail), as_object(inner))
    none = (s == "") | (s == sentinel) | (s == "[]")
    return df.select(key, F.when(none, "empty").when(json.isNotNull(), "notes").otherwise("failed").alias("state"), F.when(~none, F.from_json(json, NOTE_FIELDS)).alias("notes"))


def normalized_note(n: Column) -> Column:
    """A note of a model with text trimmed, one sentence if unknown, salience between 0 and 1 (0.5 if unknown) and the numbers
    of its sentences in order, each once."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(n["source_sent_ids"], F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())))
    salience = F.when(n["salience"].isNull(), 0.5).otherwise(F.least(F.greatest(n["salience"], F.lit(0.0)), F.lit(1.0)))
    return F.struct(F.trim(n["text"]).alias("text"), F.coalesce(n["sent_count"], F.lit(1)).alias("sent_count"), salience.alias("salience"), ids.alias("source_sent_ids"), F.coalesce(n["entities"], F.array().cast("array<string>")).alias("entities"))


def checked_answers(df: DataFrame, p: DataFrame, key: str, raw: str) -> DataFrame:
    """key, state, answer, support: the answer of a model's JSON (bare, fenced, inside a text, or a JSON text in JSON) and the
    named passages that exist, each once; where none of them holds the answer, the first that does stands for all. state: ok,
    no_json, empty or forbidden. p: key, idx, paragraph_text."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inner = F.when(fenced != "", fenced).when(s.startswith("{"), s).otherwise(F.regexp_extract(s, r"(?s)(\{.*\})", 1))
    twice = F.from_json(F.concat(F.lit('{"x":'), s, F.lit("}")), "x string")["x"]
    pick = lambda c: F.when(c.startswith("{") & F.json_object_keys(c).isNotNull(), c)
    j = F.coalesce(pick(inner), pick(F.trim(twice)))
    rows = df.select(key, j.alias("j"), F.trim(F.coalesce(F.get_json_object(j, "$.answer"), F.lit(""))).alias("answer"), F.from_json(F.get_json_object(j, "$.support_idxs"), "array<string>").alias("named"))
    rows = rows.withColumn("named", F.array_distinct(F.filter(F.transform(F.coalesce("named", F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())))
    held = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("paragraph_text", F.lit("")).alias("t")))).alias("ps"))
    x = rows.join(held, key, "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<struct<idx: int, t: string>>")))
    holding = F.transform(F.filter("ps", lambda y: F.contains(y["t"], F.col("answer"))), lambda y: y["idx"])
    legal = F.filter("named", lambda i: F.array_contains(F.transform("ps", lambda y: y["idx"]), i))
    support = F.when(F.arrays_overlap(F.col("named"), holding) | (F.size(holding) == 0), legal).otherwise(F.slice(holding, 1, 1))
    state = F.when(F.col("j").isNull(), "no_json").when(F.col("answer") == "", "empty").when(F.lower("answer").isin(FORBIDDEN), "forbidden").otherwise("ok")
    return x.select(key, state.alias("state"), F.when(state == "ok", F.col("answer")).alias("answer"), F.when(state == "ok", support).alias("support"))


def checked_spans(df: DataFrame) -> DataFrame:
    """id, n_spans, n_valid, ok, error of a final answer with its evidence. df: id, json (null if the output was none), spans
    (array of `[Ln] quoted text`), lines (the context), used_candidate, candidate.

    A span is valid if line n holds its quoted text, of four characters or more, letter case aside. Without a valid span the
    answer fails; one that claims to use the candidate needs a candidate of which a part (they stand between bars) is in
    a valid span."""
    spans = F.coalesce("spans", F.array().cast("array<string>"))
    number = lambda s: F.regexp_extract(F.trim(s), r"^\[L([0-9]+)\]", 1).try_cast("int")
    quoted = lambda s: F.trim(F.regexp_replace(F.trim(s), r"^\[L[0-9]+\]", ""))
    held = lambda s: number(s).isNotNull() & (F.char_length(quoted(s)) >= 4) & F.contains(F.lower(F.coalesce(F.get("lines", number(s) - 1), F.lit(""))), F.lower(quoted(s)))
    x = df.select("id", "json", "used_candidate", F.coalesce("candidate", F.lit("")).alias("candidate"), spans.alias("spans"), F.filter(spans, held).alias("valid"))
    parts = F.filter(F.transform(F.split("candidate", r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    supported = F.exists(parts, lambda p: F.exists("valid", lambda s: F.contains(F.lower(s), F.lower(p))))
    used = F.coalesce("used_candidate", F.lit(False))
    error = F.when(F.col("json").isNull(), "json_parse_failed").when(F.size("valid") == 0, "no_valid_evidence_spans").when(used & (F.trim("candidate") == ""), "used_candidate_without_candidate_answer").when(used & ~supported, "used_candidate_not_supported_by_spans")
    return x.select("id", F.size("spans").alias("n_spans"), F.size("valid").alias("n_valid"), error.isNull().alias("ok"), error.alias("error"))


def answer_hint(answer: Column, score: Column, others: Column, least: float = 0.70, most: int = 2) -> Column:
    """The answer if its score is `least` or more, and the other candidates, each once (letter case aside), `most` of them
    between bars; null if there is none."""
    own = F.when((F.trim(F.coalesce(answer, F.lit(""))) != "") & (score >= least), F.array(F.trim(answer))).otherwise(F.array().cast("array<string>"))
    every = F.concat(own, F.filter(F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    once = F.filter(every, lambda x, i: ~F.array_contains(F.transform(F.slice(every, 1, i), lambda y: F.lower(y)), F.lower(x)))
    return F.when(F.size(once) > 0, F.array_join(F.slice(once, 1, most), " | "))


def person_rules(df: DataFrame) -> DataFrame:
    """id, n_notes, person_coverage, valid. df: id, notes (array of struct content, persons). A note is sound if it names a
    person and its content holds one of the names or the form of a full name; all must be."""
    sound = lambda n: (F.size(F.coalesce(n["persons"], F.array().cast("array<string>"))) > 0) & (F.exists(n["persons"], lambda p: (F.coalesce(p, F.lit("")) != "") & F.contains(F.lower(n["content"]), F.lower(p))) | masked(n["content"]).rlike(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"))
    good = F.size(F.filter("notes", lambda n: F.coalesce(sound(n), F.lit(False))))
    return df.select("id", F.size("notes").alias("n_notes"), F.round(F.when(F.size("notes") > 0, good / F.size("notes")).otherwise(0.0), 6).alias("person_coverage"), (good == F.size("notes")).alias("valid"))


def requirements(c: DataFrame) -> DataFrame:
    """The candidates with wanted_names, wanted_words and wanted_kin: what the question requires of its evidence."""
    q = masked(F.col("question"))
    names = F.array_distinct(F.concat(*[F.regexp_extract_all(q, F.lit(p), F.lit(0)) for p in (NAMES, WORDS_CAPITAL)]))
    words = F.filter(tx.tokens(F.col("question")), lambda w: ~w.isin(REQUIRED_STOPS) & (F.char_length(w) > 2))
    return c.withColumn("wanted_names", names).withColumn("wanted_words", words).withColumn("wanted_kin", F.lower("question").rlike("spouse|married").cast("int"))


def relevance(c: DataFrame) -> DataFrame:
    """query, candidate, relevance: the share of required names, words and kinship that a passage holds; 0 if nothing is
    required. c: requirements."""
    low = F.lower("content")
    hits = F.size(F.filter("wanted_names", lambda x: F.contains(low, F.lower(x)))) + F.size(F.filter("wanted_words", lambda x: F.contains(low, x))) + F.col("wanted_kin") * low.rlike("spouse|married").cast("int")
    total = F.size("wanted_names") + F.size("wanted_words") + F.col("wanted_kin")
    return c.select("query", "candidate", F.round(F.when(total > 0, hits / total).otherwise(0.0), 6).alias("relevance"))


def supplements(r: DataFrame, q: DataFrame, least: float = 0.5) -> DataFrame:
    """query, candidate, relevance: passages over `least` that the answer does not name."""
    named = q.select(F.col("id").alias("query"), F.explode("predicted_support_idxs").alias("candidate")).where("candidate IS NOT NULL")
    return r.where(F.col("relevance") > least).join(named, ["query", "candidate"], "left_anti")


def content_quality(t: Column) -> Column:
    """Half the length over 200 and half the parts of more than ten characters between full stops over 2, each at most 1."""
    parts = F.size(F.filter(F.split(t, r"\."), lambda s: F.char_length(F.trim(s)) > 10))
    return F.when(t == "", 0.0).otherwise((F.least(F.lit(1.0), F.char_length(t) / 200) + F.least(F.lit(1.0), parts / 2)) / 2)


def comprehensive(c: DataFrame) -> DataFrame:
    """query, candidate, consistency, quality, score, kept: 0.4 dense + 0.3 likeness of names (1 if the question has none, 0 if
    the passage has none) + 0.2 quality + 0.1; kept with 20 characters and 0.3. c: requirements."""
    q, n = F.array_distinct(F.transform("wanted_names", lambda x: F.lower(x))), F.col("names")
    consistency = F.when(F.size(q) == 0, 1.0).when(F.size(n) == 0, 0.0).otherwise(tx.jaccard(q, n))
    c = c.withColumn("consistency", F.round(consistency, 6)).withColumn("quality", F.round(content_quality(F.col("content")), 6))
    c = c.withColumn("score", F.round(0.4 * F.col("dense") + 0.3 * F.col("consistency") + 0.2 * F.col("quality") + 0.1, 6))
    return c.select("query", "candidate", "consistency", "quality", "score", ((F.char_length("content") >= 20) & (F.col("score") >= 0.3)).alias("kept"))


def optimized(c: DataFrame) -> DataFrame:
    """query, candidate, quality, score, kept: quality 0.3 length / 200 + 0.4 share of required words + 0.3 share of required
    names; score 0.6 dense + 0.3 quality; kept with five characters, 0.05 dense and a score of 0.1. c: requirements."""
    low = F.lower("content")
    share = lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(low, F.lower(x)))) / F.size(w)).otherwise(0.0)
    quality = F.when(F.col("content") == "", 0.0).otherwise(0.3 * F.least(F.char_length("content") / 200, F.lit(1.0)) + 0.4 * share("wanted_words") + 0.3 * share("wanted_names"))
    c = c.withColumn("quality", F.round(quality, 6)).withColumn("score", F.round(0.6 * F.col("dense") + 0.3 * F.col("quality"), 6))
    return c.select("query", "candidate", "quality", "score", ((F.char_length(F.trim("content")) >= 5) & (F.col("dense") >= 0.05) & (F.col("score") >= 0.1)).alias("kept"))


def coverage(c: DataFrame) -> DataFrame:
    """query, coverage: the share of required names and words that the passages of a question hold together; 1 if nothing is
    required. c: requirements."""
    g = c.groupBy("query").agg(F.first("wanted_names").alias("n"), F.first("wanted_words").alias("w"), F.lower(F.array_join(F.collect_list("content"), " ")).alias("t"))
    hits = F.size(F.filter("n", lambda x: F.contains("t", F.lower(x)))) + F.size(F.filter("w", lambda x: F.contains("t", x)))
    total = F.size("n") + F.size("w")
    return g.select("query", F.round(F.when(total > 0, hits / total).otherwise(1.0), 6).alias("coverage"))


def _i(make):
    return lambda s, d: make(items(s, d))


def _r(make):
    return lambda s, d: make(requirements(candidates(items(s, d), passages(s, d))))


def _checked(s: SparkSession, d: str) -> DataFrame:
    q, p = items(s, d), passages(s, d)
    return checked_answers(q, p.select(F.col("item_id").alias("id"), "idx", "paragraph_text"), "id", "predicted_answer").withColumn("support", F.array_join(F.transform("support", lambda x: x.cast("string")), ","))


QUERIES = {
    "question_conjunction_parts": _i(conjunction_parts),
    "question_entity_parts": _i(entity_parts),
    "question_valid_parts": _i(lambda q: valid_parts(conjunction_parts(q), q)),
    "namespace_notes": lambda s, d: notes(s, d).where(in_namespace(F.col("source_info.file_path"), F.col("source_info.file_name"), "corpus", "harbour")).select("note_id"),
    "namespace_summary": lambda s, d: namespace_summary(notes(s, d), "corpus", "harbour"),
    "checked_answers": _checked,
    "passage_relevance": _r(relevance),
    "supplementary_passages": lambda s, d: supplements(relevance(requirements(candidates(items(s, d), passages(s, d)))), items(s, d)),
    "comprehensive_scores": _r(comprehensive),
    "optimized_scores": _r(optimized),
    "requirement_coverage": _r(coverage),
}

_W = f"WITH {sk.QA}, {sk.PASSAGES}"
_CUT = " ".join(f"WHEN len(regexp_split_to_array(coalesce(question, ''), '{p}')) > 1 THEN regexp_split_to_array(coalesce(question, ''), '{p}')" for p in CONJUNCTIONS)
_PARTS = f"""cp AS (SELECT id, CASE {_CUT} ELSE [coalesce(question, '')] END AS f FROM qa), cg AS (SELECT id, len(f) AS n, list_filter(list_transform(f, lambda x: trim(x)), lambda x: x <> '') AS g FROM cp),
ch AS (SELECT id, n, list_filter(g, lambda x, i: list_position(g, x) = i) AS g FROM cg), cu AS (SELECT id, n, g, unnest(range(1, len(g) + 1)) AS i FROM ch), parts AS (SELECT id, (i - 1)::INTEGER AS part_no, g[i] AS part, round(1 / n::DOUBLE, 6) AS priority FROM cu)"""
_SPACE = "contains(lower(coalesce(nullif(source_info.file_path, ''), source_info.file_name, '')), 'corpus') AND contains(lower(coalesce(nullif(source_info.file_path, ''), source_info.file_name, '')), 'harbour')"
_REQ = f"""rq0 AS (SELECT qa.id AS query, pa.idx AS candidate, coalesce(paragraph_text, '') AS content, lower(coalesce(paragraph_text, '')) AS low, lower(coalesce(question, '')) AS ql, list_distinct(list_concat(regexp_extract_all({sk.MASKED.format('question')}, '{NAMES}'), regexp_extract_all({sk.MASKED.format('question')}, '{WORDS_CAPITAL}'))) AS wn,
  list_filter({sk.TOKENS.format('question')}, lambda w: NOT list_contains({sk.quoted(REQUIRED_STOPS)}, w) AND length(w) > 2) AS ww, list_transform(list_distinct(regexp_extract_all({sk.MASKED.format('paragraph_text')}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b')), lambda x: lower(x)) AS names,
  round({sk.jaccard(sk.WORDS.format('question'), sk.WORDS.format('paragraph_text'))}, 6) AS dense FROM pa JOIN qa ON pa.item_id = qa.id), rq AS (SELECT *, regexp_matches(ql, 'spouse|married')::INT AS kin, len(list_filter(wn, lambda x: contains(low, lower(x)))) AS hn, len(list_filter(ww, lambda x: contains(low, x))) AS hw FROM rq0),
rel AS (SELECT query, candidate, round(CASE WHEN len(wn) + len(ww) + kin > 0 THEN (hn + hw + kin * regexp_matches(low, 'spouse|married')::INT) / (len(wn) + len(ww) + kin)::DOUBLE ELSE 0.0 END, 6) AS relevance FROM rq)"""

SQL = {
    "question_conjunction_parts": f"{_W}, {_PARTS} SELECT * FROM parts",
    "question_entity_parts": f"{_W}, e AS (SELECT id, unnest({sk.found('question', NAMES)}) AS entity FROM qa) SELECT id, entity, 'about ' || entity AS part FROM e",
    "question_valid_parts": f"""{_W}, {_PARTS}, g AS (SELECT id, list(part ORDER BY part_no) AS p FROM parts WHERE length(trim(part)) >= 5 AND (ends_with(trim(part), '?') OR regexp_matches(lower(trim(part)), '^({'|'.join(BEGINNINGS)})')) GROUP BY id)
SELECT qa.id, CASE WHEN len(p) >= 2 THEN array_to_string(p[1:5], ' | ') ELSE coalesce(question, '') END AS parts FROM qa LEFT JOIN g USING (id)""",
    "namespace_notes": f"WITH {sk.NOTES} SELECT note_id FROM notes WHERE {_SPACE}",
    "namespace_summary": f"WITH {sk.NOTES}, m AS (SELECT count(*) AS total_notes, count(*) FILTER (WHERE {_SPACE}) AS matching_notes FROM notes) SELECT *, round(CASE WHEN total_notes > 0 THEN matching_notes / total_notes::DOUBLE ELSE 0.0 END, 6) AS match_rate, matching_notes > 0 AS has_matches FROM m",
    "passage_relevance": f"{_W}, {_REQ} SELECT * FROM rel",
    "supplementary_passages": f"{_W}, {_REQ} SELECT rel.* FROM rel JOIN qa ON qa.id = rel.query WHERE relevance > 0.5 AND NOT coalesce(list_contains(predicted_support_idxs, candidate), false)",
    "comprehensive_scores": f"""{_W}, {_REQ}, a AS (SELECT *, list_distinct(list_transform(wn, lambda x: lower(x))) AS qn, len(list_filter(string_split(content, '.'), lambda s: length(trim(s)) > 10)) AS k FROM rq),
b AS (SELECT *, round(CASE WHEN len(qn) = 0 THEN 1.0 WHEN len(names) = 0 THEN 0.0 ELSE {sk.jaccard('qn', 'names')} END, 6) AS consistency, round(CASE WHEN content = '' THEN 0.0 ELSE (least(1.0, length(content) / 200.0::DOUBLE) + least(1.0, k / 2.0::DOUBLE)) / 2 END, 6) AS quality FROM a),
s AS (SELECT *, round(0.4::DOUBLE * dense + 0.3::DOUBLE * consistency + 0.2::DOUBLE * quality + 0.1::DOUBLE, 6) AS score FROM b) SELECT query, candidate, consistency, quality, score, length(content) >= 20 AND score >= 0.3 AS kept FROM s""",
    "optimized_scores": f"""{_W}, {_REQ}, b AS (SELECT *, round(CASE WHEN content = '' THEN 0.0 ELSE 0.3::DOUBLE * least(length(content) / 200.0::DOUBLE, 1.0) + 0.4::DOUBLE * CASE WHEN len(ww) > 0 THEN hw / len(ww)::DOUBLE ELSE 0.0 END + 0.3::DOUBLE * CASE WHEN len(wn) > 0 THEN hn / len(wn)::DOUBLE ELSE 0.0 END END, 6) AS quality FROM rq),
s AS (SELECT *, round(0.6::DOUBLE * dense + 0.3::DOUBLE * quality, 6) AS score FROM b) SELECT query, candidate, quality, score, length(trim(content)) >= 5 AND dense >= 0.05 AND score >= 0.1 AS kept FROM s""",
    "requirement_coverage": f"""{_W}, {_REQ}, g AS (SELECT query, any_value(wn) AS n, any_value(ww) AS w, lower(string_agg(content, ' ')) AS t FROM rq GROUP BY query)
SELECT query, round(CASE WHEN len(n) + len(w) > 0 THEN (len(list_filter(n, lambda x: contains(t, lower(x)))) + len(list_filter(w, lambda x: contains(t, x)))) / (len(n) + len(w))::DOUBLE ELSE 1.0 END, 6) AS coverage FROM g""",
}
