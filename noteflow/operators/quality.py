"""Quality of notes: complete sentences, noise, weighted scores, the filter chain, limits of a chunk, valid entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import sqlkit as sk
from noteflow.functions import text as tx
from noteflow.operators.extraction import masked
from noteflow.operators.notes import notes

# Signs of verbs, beginnings of fragments, stop words, words that tell of quality or make a context meaningful.
VERBS = r"(?i)\b(is|are|was|were|has|have|had|includes?|included|include|acquired|founded|located|born|won|announced|reported|published|proposed|launched)\b"
VERBS_ZH = "是|为|位于|属于|出生|成立|获得|提出|报道|宣布|包含|推出|发布"
BAD_STARTS = r"(?i)^(because|due to|such as|including|with|without|after|before)\b"
BAD_STARTS_ZH = "^(因为|由于|其中|包括|以及)"
STOPS = "the a an and or but in on at to for of with by".split()
INDICATORS = {
    "factual": ["born", "died", "created", "founded", "established", "married", "divorced"],
    "descriptive": ["known for", "famous for", "characterized by", "described as"],
    "relational": ["son of", "daughter of", "married to", "worked with", "collaborated"],
    "temporal": ["in", "during", "before", "after", "since", "until"],
    "quantitative": ["first", "last", "most", "least", "many", "few", "several"],
}
MEANINGFUL = "is was are were has had have does did do created made born died married worked lived known famous voice actor character role played portrayed".split()
WEIGHTS = {"completeness": 0.25, "relevance": 0.25, "density": 0.20, "linguistic": 0.15, "factual": 0.15}
NO_ENTITIES = "the and or but in on at to for of with by".split()


def text_of(c: str = "content") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def names_of(c: str = "entities") -> Column:
    """The entities of a note that are neither null nor blank."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda e: ~tx.blank(e))


def split_words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def is_complete(t: Column) -> Column:
    """True for a text with an end mark, four words or eight Han characters, a verb, and no beginning of a fragment."""
    t = F.trim(t)
    han = F.char_length(F.regexp_replace(t, r"[^\p{IsHan}]", ""))
    m = masked(t)
    return t.rlike(r"[。.!?]$") & ((F.size(tx.tokens(t)) >= 4) | (han >= 8)) & (m.rlike(VERBS) | t.rlike(VERBS_ZH)) & ~(m.rlike(BAD_STARTS) | t.rlike(BAD_STARTS_ZH))


def sentence_share(t: Column) -> Column:
    """The share of parts between end marks that have more than ten characters."""
    parts = F.split(t, r"[.!?]+")
    return F.size(F.filter(parts, lambda s: F.char_length(F.trim(s)) > 10)) / F.size(parts)


def content_completeness(t: Column) -> Column:
    """0 under 20 characters, else half the share of sentences and half the length over 200."""
    return F.when(F.char_length(F.trim(t)) < 20, 0.0).otherwise((sentence_share(t) + F.least(F.char_length(t) / 200, F.lit(1.0))) / 2)


def information_density(t: Column) -> Column:
    """0 under five words, else the share of words of three ASCII letters and more that are no stop words, 0.1 more for each
    kind of indicator in the text, at most 1."""
    words = split_words(t)
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    dense = F.size(F.filter(bare, lambda w: (F.char_length(w) > 2) & ~w.isin(STOPS)))
    low = F.lower(t)
    bonus = sum((low.rlike("|".join(v)).cast("int") for v in INDICATORS.values()), F.lit(0))
    return F.when(F.size(words) < 5, 0.0).otherwise(F.least(dense / F.size(words) + 0.1 * bonus, F.lit(1.0)))


def occurrences(t: Column, e: Column) -> Column:
    """The places (from 1) at which e occurs in t, overlapping ones too."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(t))), lambda i: F.substring(t, i, F.char_length(e)) == e)


def entity_relevance(t: Column, names: Column) -> Column:
    """The share of entities that occur within 20 characters of a word of meaning; 0.5 without entities."""
    low = F.lower(t)

    def meant(e: Column) -> Column:
        e = F.lower(e)
        near = lambda i: F.substring(low, F.greatest(F.lit(1), i - 20), F.least(i - 1, F.lit(20)) + F.char_length(e) + 20)
        return F.exists(occurrences(low, e), lambda i: F.arrays_overlap(tx.tokens(near(i)), F.array(*[F.lit(w) for w in MEANINGFUL])))

    return F.when(F.size(names) == 0, 0.5).otherwise(F.size(F.filter(names, meant)) / F.size(names))


def linguistic_quality(t: Column) -> Column:
    """0.5, and 0.2 for a sentence from capital to end mark, 0.1 for an end mark, 0.1 for letters of both cases, 0.1 times the
    share of different words; 0 for an empty text."""
    w = tx.tokens(t)
    kinds = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)
    score = 0.5 + 0.2 * t.rlike(r"[A-Z][^.!?]*[.!?]").cast("int") + 0.1 * t.rlike("[.!?]").cast("int") + 0.1 * (t.rlike("[A-Z]") & t.rlike("[a-z]")).cast("int") + 0.1 * kinds
    return F.when(t == "", 0.0).otherwise(F.least(score, F.lit(1.0)))


def factual_consistency(t: Column) -> Column:
    """Half the different capitalised words over 5, half the different numbers over 3, each at most 1."""
    kinds = lambda p, n: F.least(F.size(F.array_distinct(F.regexp_extract_all(masked(t), F.lit(p), F.lit(0)))) / n, F.lit(1.0))
    return (kinds(r"\b[A-Z][a-z]+\b", 5) + kinds(r"\b[0-9]+\b", 3)) / 2


def scores(n: DataFrame) -> DataFrame:
    """note_id, the five sub-scores, overall (weighted) and level: high from 0.8, medium from 0.6, low from 0.4, else very_low."""
    t = text_of()
    parts = {"completeness": content_completeness(t), "relevance": entity_relevance(t, names_of()), "density": information_density(t), "linguistic": linguistic_quality(t), "factual": factual_consistency(t)}
    s = n.select("note_id", *[tx.rounded(v, 6).alias(k) for k, v in parts.items()])
    s = s.withColumn("overall", tx.rounded(sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0)), 6))
    return s.withColumn("level", F.when(F.col("overall") >= 0.8, "high").when(F.col("overall") >= 0.6, "medium").when(F.col("overall") >= 0.4, "low").otherwise("very_low"))


def usefulness(n: DataFrame) -> Column:
    """0.4 importance (0.5 if unknown) + 0.3 length / 100 + 0.3 share of entities that the text holds, between 0 and 1."""
    t = text_of()
    held = F.size(F.filter(names_of(), lambda e: F.contains(F.lower(t), F.lower(e))))
    score = 0.4 * F.coalesce("importance_score", F.lit(0.5)) + 0.3 * F.least(F.char_length(t) / 100, F.lit(1.0)) + 0.3 * held / F.greatest(F.lit(1), F.size(names_of()))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def obvious_noise(t: Column) -> Column:
    """Blank, dots, marks only, a lone stop word, digits only, under 20 characters, or fewer than 3 different characters."""
    kinds = F.size(F.filter(F.array_distinct(F.split(F.replace(t, F.lit(" "), F.lit("")), "")), lambda x: x != ""))
    return t.rlike(r"^\s*(\.\.\.)?$") | t.rlike(r"^\s*[^a-zA-Z0-9\x{4e00}-\x{9fff}]*$") | t.rlike(r"(?i)^\s*(the|a|an|and|or|but)\s*$") | t.rlike(r"^\s*[0-9]+\s*$") | (F.char_length(F.trim(t)) < 20) | (kinds < 3)


def noise(n: DataFrame) -> DataFrame:
    """note_id, usefulness, overall, is_noise, reason: noise if obvious; no noise over 0.65 usefulness; else noise if the
    overall quality is under 0.4."""
    j = n.select("note_id", obvious_noise(text_of()).alias("obvious"), tx.rounded(usefulness(n), 6).alias("usefulness")).join(scores(n).select("note_id", "overall"), "note_id")
    reason = F.when(F.col("obvious"), "obvious_noise").when(F.col("usefulness") > 0.65, None).when(F.col("overall") < 0.4, "low_quality")
    return j.select("note_id", "usefulness", "overall", reason.isNotNull().alias("is_noise"), reason.alias("reason"))


def structure_valid() -> Column:
    """A text that is a complete sentence, a positive number of sentences, an importance between 0 and 1."""
    return ~tx.blank(F.col("content")) & (F.coalesce("sent_count", F.lit(0)) >= 1) & F.coalesce(F.col("importance_score").between(0, 1), F.lit(False)) & is_complete(text_of())


def filter_chain(n: DataFrame, low: int = 20, high: int = 400, sentences: int = 3, salience: float = 0.2, most: int = 12) -> DataFrame:
    """note_id, place: complete sentences of 20 to 400 characters, at most 3 sentences, enough importance (unknown counts as
    0), flagged OK and nothing bad; of equal texts of a chunk the first; of each chunk the `most` most important."""
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    bad = F.array(*[F.lit(x) for x in ("DUPLICATE", "LOW_INFO", "TOO_LONG")])
    kept = n.where(
        is_complete(text_of()) & F.char_length("content").between(low, high) & F.coalesce("sent_count", F.lit(1)).between(1, sentences)
        & (F.coalesce("importance_score", F.lit(0.0)) >= salience) & F.array_contains(flags, "OK") & ~F.arrays_overlap(flags, bad)
    ).select("note_id", "importance_score", F.col("source_info.file_name").alias("file"), "chunk_index", F.md5("content").alias("h"))
    first = Window.partitionBy("file", "chunk_index", "h").orderBy("note_id")
    one = kept.withColumn("n", F.row_number().over(first)).where("n = 1")
    w = Window.partitionBy("file", "chunk_index").orderBy(F.desc("importance_score"), "note_id")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("note_id", "place")


def bucketed_limit(n: DataFrame, most: int = 12, quota: int = 1) -> DataFrame:
    """note_id, place: at most `most` notes of a chunk, first the `quota` most important of each paragraph (the first cited
    one), then the rest by importance; ties by note_id."""
    rows = n.select("note_id", F.coalesce("importance_score", F.lit(0.0)).alias("i"), F.col("source_info.file_name").alias("file"), "chunk_index", F.get("paragraph_idxs", F.lit(0)).alias("paragraph"))
    r = rows.withColumn("n", F.row_number().over(Window.partitionBy("file", "chunk_index", "paragraph").orderBy(F.desc("i"), "note_id")))
    w = Window.partitionBy("file", "chunk_index").orderBy((F.col("n") > quota).cast("int"), F.desc("i"), "note_id")
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("note_id", "place")


def canonical(e: Column) -> Column:
    """Trimmed, white space collapsed, the first character in upper case."""
    c = tx.clean(e)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.char_length(c)))


# Forms of evidence that name two entities.
EVIDENCE = [
    r"(?i)([A-Z][\p{L}\p{N}_\s]+?)\s+(co founded|founded|located in|member of|works for|part of|instance of)\s+([A-Z][\p{L}\p{N}_\s]+)",
    r"(?i)([A-Z][\p{L}\p{N}_\s]+?)\s+(is|was|are|were)\s+([A-Z][\p{L}\p{N}_\s]+)",
]


def entity_index(n: DataFrame, low: int = 2, high: int = 100) -> DataFrame:
    """note_id, entity: the valid entities of a note once - of its list and of the forms of evidence in its content - under
    their canonical names: 2 to 100 characters and no stop word."""
    told = [F.transform(F.regexp_extract_all(text_of(), F.lit(p), F.lit(g)), lambda x: F.trim(x)) for p in EVIDENCE for g in (1, 3)]
    every = F.array_distinct(F.transform(F.concat(names_of(), *told), canonical))
    return n.select("note_id", F.explode(every).alias("entity")).where(F.char_length("entity").between(low, high) & ~F.lower("entity").isin(NO_ENTITIES))


def _n(make):
    return lambda s, d: make(notes(s, d))


QUERIES = {
    "note_complete_sentences": _n(lambda n: n.select("note_id", is_complete(text_of()).alias("complete"))),
    "note_quality_scores": _n(scores),
    "note_noise_flags": _n(noise),
    "note_structure": _n(lambda n: n.where(structure_valid()).select("note_id")),
    "note_filter_chain": _n(filter_chain),
    "notes_per_chunk_bucketed": _n(bucketed_limit),
    "entity_evidence_index": _n(lambda n: entity_index(n).groupBy("entity").agg(F.count(F.lit(1)).alias("note_count"), F.min("note_id").alias("first_note"))),
}

_W = f"WITH {sk.NOTES}"
_T = "coalesce(content, '')"


def _complete(t: str) -> str:
    m = sk.MASKED.format(f"trim({t})")
    return f"""(regexp_matches(trim({t}), '[。.!?]$') AND (len({sk.TOKENS.format(f'trim({t})')}) >= 4 OR length(regexp_replace({t}, '[^\\p{{Han}}]', '', 'g')) >= 8) AND (regexp_matches({m}, '{VERBS}') OR regexp_matches({t}, '{VERBS_ZH}'))
  AND NOT (regexp_matches({m}, '{BAD_STARTS}') OR regexp_matches(trim({t}), '{BAD_STARTS_ZH}')))"""


_PARTS = "regexp_split_to_array(t, '[.!?]+')"
_SHARE = f"(len(list_filter({_PARTS}, lambda s: length(trim(s)) > 10)) / len({_PARTS})::DOUBLE)"
_BONUS = " + ".join(f"regexp_matches(lower(t), '{'|'.join(v)}')::INT" for v in INDICATORS.values())
_NEAR = "substr(lower(t), greatest(1, i - 20), least(i - 1, 20) + length(e) + 20)"
_MEANT = f"len(list_filter(range(1, length(t) + 1), lambda i: substr(lower(t), i, length(e)) = lower(e) AND list_has_any({sk.TOKENS.format(_NEAR)}, {sk.quoted(MEANINGFUL)}))) > 0"
_SCORES = f"""b AS (SELECT note_id, {_T} AS t, {sk.ENTS} AS ents, importance_score FROM notes), w AS (SELECT *, {sk.SPLIT.format('t')} AS words, {sk.TOKENS.format('t')} AS tok FROM b),
p AS (SELECT note_id, t, ents, importance_score, round(CASE WHEN length(trim(t)) < 20 THEN 0.0 ELSE ({_SHARE} + least(length(t) / 200.0::DOUBLE, 1.0)) / 2 END, 6) AS completeness,
  round(CASE WHEN len(ents) = 0 THEN 0.5 ELSE len(list_filter(ents, lambda e: {_MEANT})) / len(ents)::DOUBLE END, 6) AS relevance,
  round(CASE WHEN len(words) < 5 THEN 0.0 ELSE least(len(list_filter(list_transform(words, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains({sk.quoted(STOPS)}, w))) / len(words)::DOUBLE + 0.1::DOUBLE * ({_BONUS}), 1.0) END, 6) AS density,
  round(CASE WHEN t = '' THEN 0.0 ELSE least(0.5::DOUBLE + 0.2::DOUBLE * regexp_matches(t, '[A-Z][^.!?]*[.!?]')::INT + 0.1::DOUBLE * regexp_matches(t, '[.!?]')::INT + 0.1::DOUBLE * (regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]'))::INT
    + 0.1::DOUBLE * CASE WHEN len(tok) > 0 THEN len(list_distinct(tok)) / len(tok)::DOUBLE ELSE 0.0 END, 1.0) END, 6) AS linguistic,
  round((least(len({sk.found('t', chr(92) + 'b[A-Z][a-z]+' + chr(92) + 'b')}) / 5.0::DOUBLE, 1.0) + least(len({sk.found('t', chr(92) + 'b[0-9]+' + chr(92) + 'b')}) / 3.0::DOUBLE, 1.0)) / 2, 6) AS factual FROM w),
sc AS (SELECT *, round(0.25::DOUBLE * completeness + 0.25::DOUBLE * relevance + 0.20::DOUBLE * density + 0.15::DOUBLE * linguistic + 0.15::DOUBLE * factual, 6) AS overall FROM p)"""
_CANON = "upper(left({0}, 1)) || substr({0}, 2)"
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_TOLD = ", ".join(f"list_transform(regexp_extract_all(coalesce(content, ''), '{p}', {g}), lambda x: trim(x))" for p in EVIDENCE for g in (1, 3))

SQL = {
    "note_complete_sentences": f"{_W} SELECT note_id, {_complete(_T)} AS complete FROM notes",
    "note_quality_scores": f"{_W}, {_SCORES} SELECT note_id, completeness, relevance, density, linguistic, factual, overall, CASE WHEN overall >= 0.8 THEN 'high' WHEN overall >= 0.6 THEN 'medium' WHEN overall >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM sc",
    "note_noise_flags": f"""{_W}, {_SCORES}, u AS (SELECT note_id, overall, round(least(greatest(0.4::DOUBLE * coalesce(importance_score, 0.5) + 0.3::DOUBLE * least(length(t) / 100.0::DOUBLE, 1.0) + 0.3::DOUBLE * len(list_filter(ents, lambda e: contains(lower(t), lower(e)))) / greatest(1, len(ents)), 0.0), 1.0), 6) AS usefulness,
  regexp_full_match(t, '\\s*(\\.\\.\\.)?') OR regexp_full_match(t, '\\s*[^a-zA-Z0-9\\x{{4e00}}-\\x{{9fff}}]*') OR regexp_full_match(t, '(?i)\\s*(the|a|an|and|or|but)\\s*') OR regexp_full_match(t, '\\s*[0-9]+\\s*') OR length(trim(t)) < 20
  OR len(list_filter(list_distinct(string_split(replace(t, ' ', ''), '')), lambda x: x <> '')) < 3 AS obvious FROM sc),
r AS (SELECT note_id, usefulness, overall, CASE WHEN obvious THEN 'obvious_noise' WHEN usefulness > 0.65 THEN NULL WHEN overall < 0.4 THEN 'low_quality' END AS reason FROM u) SELECT note_id, usefulness, overall, reason IS NOT NULL AS is_noise, reason FROM r""",
    "note_structure": f"{_W} SELECT note_id FROM notes WHERE NOT {sk.BLANK.format('content')} AND coalesce(sent_count, 0) >= 1 AND coalesce(importance_score BETWEEN 0 AND 1, false) AND {_complete(_T)}",
    "note_filter_chain": f"""{_W}, k AS (SELECT note_id, importance_score, source_info.file_name AS file, chunk_index, md5(content) AS h FROM notes WHERE {_complete(_T)} AND length(content) BETWEEN 20 AND 400 AND coalesce(sent_count, 1) BETWEEN 1 AND 3 AND coalesce(importance_score, 0.0) >= 0.2
  AND list_contains(coalesce(quality_flags, []::VARCHAR[]), 'OK') AND NOT list_has_any(coalesce(quality_flags, []::VARCHAR[]), ['DUPLICATE', 'LOW_INFO', 'TOO_LONG'])),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY file, chunk_index, h ORDER BY note_id) = 1) SELECT note_id, row_number() OVER (PARTITION BY file, chunk_index ORDER BY importance_score DESC, note_id)::INTEGER AS place FROM o QUALIFY place <= 12""",
    "notes_per_chunk_bucketed": f"""{_W}, r AS (SELECT note_id, coalesce(importance_score, 0.0) AS i, source_info.file_name AS file, chunk_index, row_number() OVER (PARTITION BY source_info.file_name, chunk_index, paragraph_idxs[1] ORDER BY coalesce(importance_score, 0.0) DESC, note_id) AS n FROM notes)
SELECT note_id, row_number() OVER (PARTITION BY file, chunk_index ORDER BY (n > 1)::INT, i DESC, note_id)::INTEGER AS place FROM r QUALIFY place <= 12""",
    "entity_evidence_index": f"""{_W}, e AS (SELECT note_id, list_concat({sk.ENTS}, {_TOLD}) AS e FROM notes), c AS (SELECT note_id, unnest(list_distinct(list_transform(list_transform(e, lambda x: {_CLEAN.format('x')}), lambda x: {_CANON.format('x')}))) AS entity FROM e)
SELECT entity, count(*) AS note_count, min(note_id) AS first_note FROM c WHERE length(entity) BETWEEN 2 AND 100 AND NOT list_contains({sk.quoted(NO_ENTITIES)}, lower(entity)) GROUP BY entity""",
}
