"""Relations read from notes and questions: predicates, entities by rule, spouses, relations between the entities of a note,
likeness of notes, vectors compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions import sqlkit as sk
from noteflow.functions import text as tx
from noteflow.functions.runtime import lookup_join, stage, table
from noteflow.operators import vectors
from noteflow.operators.evaluation import items
from noteflow.operators.extraction import masked
from noteflow.operators.notes import notes

# Forms of predicates, common verbs, what predicates are called, forms of entities.
PREDICATE_FORMS = [
    r"\b(?:founded|established|created|built)\s+(?:by|in)\b", r"\b(?:located|situated|based)\s+(?:in|at|on)\b", r"\b(?:member|part)\s+of\b", r"\b(?:worked|employed)\s+(?:at|for|in)\b",
    r"\b(?:born|died)\s+(?:in|on|at)\b", r"\b(?:graduated|studied)\s+(?:from|at)\b", r"\b(?:married|divorced)\s+(?:to|from)\b", r"\b(?:owns|owned|operates)\b", r"\b(?:leads|led|manages|managed)\b", r"\b(?:instance|type|kind)\s+of\b",
]
COMMON_VERBS = "is was are were has have had will would could should".split()
PREDICATES = {
    "founded": "founded_by", "established": "founded_by", "created": "created_by", "located": "located_in", "situated": "located_in", "based": "located_in", "member": "member_of", "part": "part_of",
    "worked": "worked_at", "employed": "worked_at", "born": "born_in", "died": "died_in", "graduated": "graduated_from", "studied": "studied_at", "married": "married_to", "owns": "owns", "owned": "owns",
    "operates": "operates", "leads": "leads", "led": "leads", "manages": "manages", "managed": "manages", "instance": "instance_of", "type": "instance_of",
}
ENTITY_FORMS = [r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", r"\b[A-Z]{2,}\b", r"\b[0-9]{4}\b"]
SPOUSES = [rf"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*){link} ([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)" for link in (" is married to", "'s wife", "'s husband", "'s spouse")]
BETWEEN = {"ownership": ["的", "of", "belongs to"], "creation": ["创建", "建立", "created", "established"], "location": ["位于", "在", "located", "in"], "identity": ["是", "is", "are"]}


def text_predicates(c: Column) -> Column:
    """The predicates of a text, normalized, each once, by name: its forms of predicates and the first five words in -ed, -ing
    and -s of four letters and more; prepositions are dropped and known words take their names."""
    low = F.lower(masked(c))
    formed = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in PREDICATE_FORMS]))
    verbs = F.slice(F.filter(F.regexp_extract_all(low, F.lit(r"\b\w+(?:ed|ing|s)\b"), F.lit(0)), lambda w: ~w.isin(COMMON_VERBS) & (F.char_length(w) > 3)), 1, 5)
    bare = F.transform(F.concat(formed, verbs), lambda p: F.trim(F.regexp_replace(p, r"\s+(?:of|in|at|on|by|to|from|for)\b", "")))
    names = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(bare, lambda p: F.coalesce(names[p], F.when(F.char_length(p) > 2, p))), lambda p: p.isNotNull())))


def rule_entities(c: Column) -> Column:
    """Names, acronyms and years of a text, each once, by text."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(masked(c), F.lit(p), F.lit(0)) for p in ENTITY_FORMS]))))


def named_entities(c: Column) -> Column:
    """Names, acronyms, years, dates, companies and universities of three characters and more, their words capitalised, each
    once, by text."""
    forms = [*ENTITY_FORMS, r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b", r"\b[A-Z][a-z]*\s+(?:Inc|Corp|Ltd|LLC|Co)\b", r"\b(?:University|College|Institute)\s+of\s+[A-Z][a-z]+\b"]
    every = F.flatten(F.array(*[F.regexp_extract_all(masked(c), F.lit(p), F.lit(0)) for p in forms]))
    words = lambda x: F.array_join(F.transform(F.split(tx.clean(x), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.char_length(w))))), " ")
    return F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda x: F.char_length(F.trim(x)) > 2), words)))


def fallback_entities(c: Column, least: int = 2) -> Column:
    """Names of two letters and more and runs of Han characters, each once whatever its letter case, by text."""
    names = F.filter(F.regexp_extract_all(masked(c), F.lit(ENTITY_FORMS[0]), F.lit(0)), lambda x: F.char_length(F.regexp_replace(x, r"\s", "")) >= 2)
    han = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"[\x{{4e00}}-\x{{9fff}}]{{{least},}}"), F.lit(0))
    every = F.array_sort(F.array_distinct(F.concat(names, han)))
    return F.filter(every, lambda x, i: ~F.array_contains(F.transform(F.slice(every, 1, i), lambda y: F.lower(y)), F.lower(x)))


def spouse_relations(n: DataFrame, weight: float = 0.9) -> DataFrame:
    """source_id, target_id, name_a, name_b, weight: for every statement of a marriage, each pair of a note that lists the one
    name and a note that lists the other. Names in a marriage are in few notes; frequent ones are salted in the join."""
    told = F.array(*[F.transform(F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("b")), lambda x: x) for p in SPOUSES])
    pairs = n.where("content IS NOT NULL").select(F.explode(F.flatten(told)).alias("x")).select(F.trim("x.a").alias("name_a"), F.trim("x.b").alias("name_b")).distinct()
    held = stage(n.select("note_id", F.explode(F.array_distinct(F.filter("entities", lambda e: e.isNotNull()))).alias("name")), "entity-notes")
    pairs = stage(pairs, "marriages")
    a = held.join(pairs, F.col("name") == F.col("name_a")).select("name_a", "name_b", F.col("note_id").alias("source_id"))
    both = a.join(held.select(F.col("name").alias("name_b"), F.col("note_id").alias("target_id")), "name_b").where("source_id != target_id")
    return both.select("source_id", "target_id", "name_a", "name_b", F.lit(weight).alias("weight")).distinct()


def entity_relations(n: DataFrame) -> DataFrame:
    """note_id, source, target, kind: for each two entities of a note (in the order of its list) that its content holds, what
    the text from the first to the end of the second tells: ownership, creation, location, identity, else related."""
    own = F.array_distinct(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~tx.blank(e)))
    rows = n.select("note_id", F.lower(F.coalesce("content", F.lit(""))).alias("t"), own.alias("e"))
    rows = rows.select("note_id", "t", "e", F.posexplode("e").alias("i", "source")).select("note_id", "t", "source", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("target"))
    rows = rows.withColumn("p", F.expr("instr(t, lower(source))")).withColumn("q", F.expr("instr(t, lower(target))")).where("p > 0 AND q > 0")
    start = F.least("p", "q")
    between = F.substring(F.col("t"), start, F.greatest(F.col("p") + F.char_length("source"), F.col("q") + F.char_length("target")) - start)
    kind = F.coalesce(*[F.when(between.rlike("|".join(w)), k) for k, w in BETWEEN.items()], F.lit("related"))
    return rows.select("note_id", "source", "target", kind.alias("kind"))


def relation_totals(r: DataFrame) -> DataFrame:
    """kind, relations, notes: how many relations of a kind there are, and in how many notes."""
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("note_id").alias("notes"))


def topic_links(n: DataFrame) -> DataFrame:
    """note_id, topic, cohesion, links: the notes of a topic (title) are all related with each other: the topic as class id, the
    number of partners of a note, and the repeated over the different keywords of the topic (1 alone, 0.5 without any)."""
    base = stage(n.where(~tx.blank(F.col("title"))).select("note_id", tx.clean(F.col("title")).alias("topic"), "keywords"), "topics")
    words = base.select("topic", F.explode("keywords").alias("k")).where("k IS NOT NULL").groupBy("topic", "k").agg(F.count(F.lit(1)).alias("c"))
    words = words.groupBy("topic").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("c") > 1).alias("again"))
    t = base.groupBy("topic").agg(F.count(F.lit(1)).alias("size")).join(words, "topic", "left")
    cohesion = F.when(F.col("size") < 2, 1.0).when(F.col("kinds").isNull(), 0.5).otherwise(F.col("again") / F.col("kinds"))
    return lookup_join(base.select("note_id", "topic"), t.select("topic", F.round(cohesion, 6).alias("cohesion"), (F.col("size") - 1).alias("links")), ["topic"]).select("note_id", "topic", "cohesion", "links")


def pair_similarities(a: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, cosine, euclid (1 / (1 + distance)), dot of pairs of vectors. a: id, e; pairs: a, b."""
    j = pairs.join(a.toDF("a", "x"), "a").join(a.toDF("b", "y"), "b")
    dot = vectors.dot(F.col("x"), F.col("y"))
    distance = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    return j.select("a", "b", F.round(dot / (vectors.norm(F.col("x")) * vectors.norm(F.col("y")) + 1e-8), 6).alias("cosine"), F.round(1 / (1 + distance), 6).alias("euclid"), F.round(dot, 5).alias("dot"))


def _n(make):
    return lambda s, d: make(notes(s, d))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """The first note's vector of each relation's ends, for relations whose source file number is divisible by 50."""
    e = vectors.usable(table(s, d, "note_embeddings"), "embedding").where(F.size("embedding") == 128)
    one = e.groupBy("note_id").agg(F.min(F.struct("vec_id", "embedding")).alias("m")).select("note_id", F.col("m.embedding").alias("e"))
    r = table(s, d, "note_relations").where("source_id IS NOT NULL AND target_id IS NOT NULL").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    return pair_similarities(one, r.where(F.regexp_extract("a", r"^note_[a-z]+_(\d+)_", 1).try_cast("int") % 50 == 0))


QUERIES = {
    "question_predicates": lambda s, d: items(s, d).select("id", F.array_join(text_predicates(F.col("question")), ",").alias("predicates")),
    "note_text_predicates": _n(lambda n: n.select("note_id", F.array_join(text_predicates(F.col("content")), ",").alias("predicates"))),
    "note_rule_entities": _n(lambda n: n.select("note_id", F.array_join(rule_entities(F.col("content")), "|").alias("entities"))),
    "note_named_entities": _n(lambda n: n.select("note_id", F.array_join(named_entities(F.col("original_text")), "|").alias("entities"))),
    "note_fallback_entities": _n(lambda n: n.select("note_id", F.array_join(fallback_entities(F.col("original_text")), "|").alias("entities"))),
    "note_entity_relations": _n(entity_relations),
    "note_relation_totals": _n(lambda n: relation_totals(entity_relations(n))),
    "topic_links": _n(topic_links),
    "vector_pair_similarities": _pairs,
}

_W = f"WITH {sk.NOTES}"
_NAMES = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREDICATES.items()) + " ELSE CASE WHEN length(p) > 2 THEN p END END"


def _predicates(t: str) -> str:
    low = f"lower({sk.MASKED.format(t)})"
    formed = ", ".join(f"regexp_extract_all({low}, '{p}')" for p in PREDICATE_FORMS)
    verbs = f"list_filter(regexp_extract_all({low}, '\\b\\w+(?:ed|ing|s)\\b'), lambda w: length(w) > 3 AND NOT list_contains({sk.quoted(COMMON_VERBS)}, w))[1:5]"
    bare = f"list_transform(list_concat({formed}, {verbs}), lambda p: trim(regexp_replace(p, '\\s+(?:of|in|at|on|by|to|from|for)\\b', '', 'g')))"
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({bare}, lambda p: {_NAMES}), lambda p: p IS NOT NULL))), ',')"


_RULED = ", ".join(f"regexp_extract_all({sk.MASKED.format('content')}, '{p}')" for p in ENTITY_FORMS)
_FORMS = [*ENTITY_FORMS, "\\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\\b", "\\b[A-Z][a-z]*\\s+(?:Inc|Corp|Ltd|LLC|Co)\\b", "\\b(?:University|College|Institute)\\s+of\\s+[A-Z][a-z]+\\b"]
_NAMED = "list_concat(" + ", ".join(f"regexp_extract_all({sk.MASKED.format('original_text')}, '{p}')" for p in _FORMS) + ")"
_CAPITAL = "array_to_string(list_transform(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_EREL = f"""{_W}, r AS (SELECT note_id, lower(coalesce(content, '')) AS t, list_filter({sk.ENTS}, lambda x, i: list_position({sk.ENTS}, x) = i) AS e FROM notes), i AS (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM r), j AS (SELECT *, unnest(range(i + 1, len(e) + 1)) AS j FROM i),
p AS (SELECT note_id, t, e[i] AS source, e[j] AS target, strpos(t, lower(e[i])) AS p, strpos(t, lower(e[j])) AS q FROM j), b AS (SELECT note_id, source, target, substr(t, least(p, q), greatest(p + length(source), q + length(target)) - least(p, q)) AS b FROM p WHERE p > 0 AND q > 0),
er AS (SELECT note_id, source, target, CASE {' '.join(f"WHEN regexp_matches(b, '{'|'.join(w)}') THEN '{k}'" for k, w in BETWEEN.items())} ELSE 'related' END AS kind FROM b)"""

SQL = {
    "question_predicates": f"WITH {sk.QA} SELECT id, {_predicates('question')} AS predicates FROM qa",
    "note_text_predicates": f"{_W} SELECT note_id, {_predicates('content')} AS predicates FROM notes",
    "note_rule_entities": f"{_W} SELECT note_id, array_to_string(list_sort(list_distinct(list_concat({_RULED}))), '|') AS entities FROM notes",
    "note_named_entities": f"{_W} SELECT note_id, array_to_string(list_sort(list_distinct(list_transform(list_filter({_NAMED}, lambda x: length(trim(x)) > 2), lambda x: {_CAPITAL}))), '|') AS entities FROM notes",
    "note_fallback_entities": f"""{_W}, e AS (SELECT note_id, list_sort(list_distinct(list_concat(list_filter(regexp_extract_all({sk.MASKED.format('original_text')}, '{ENTITY_FORMS[0]}'), lambda x: length(regexp_replace(x, '\\s', '', 'g')) >= 2), regexp_extract_all(coalesce(original_text, ''), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')))) AS e FROM notes)
SELECT note_id, array_to_string(list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i), '|') AS entities FROM e""",
    "note_entity_relations": f"{_EREL} SELECT * FROM er",
    "note_relation_totals": f"{_EREL} SELECT kind, count(*) AS relations, count(DISTINCT note_id) AS notes FROM er GROUP BY kind",
    "topic_links": f"""{_W}, b AS (SELECT note_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS topic, keywords FROM notes WHERE NOT {sk.BLANK.format('title')}), k AS (SELECT topic, k, count(*) AS c FROM (SELECT topic, unnest(keywords) AS k FROM b) WHERE k IS NOT NULL GROUP BY ALL),
w AS (SELECT topic, count(*) AS kinds, count(*) FILTER (WHERE c > 1) AS again FROM k GROUP BY topic), t AS (SELECT topic, count(*) AS size FROM b GROUP BY topic)
SELECT note_id, b.topic, round(CASE WHEN size < 2 THEN 1.0 WHEN kinds IS NULL THEN 0.5 ELSE again / kinds::DOUBLE END, 6)::DOUBLE AS cohesion, size - 1 AS links FROM b JOIN t ON t.topic = b.topic LEFT JOIN w ON w.topic = b.topic""",
    "vector_pair_similarities": """WITH u AS (SELECT note_id, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM note_embeddings WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND note_id IS NOT NULL GROUP BY note_id),
r AS (SELECT DISTINCT source_id AS a, target_id AS b FROM note_relations WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND try_cast(regexp_extract(source_id, '^note_[a-z]+_(\\d+)_', 1) AS INTEGER) % 50 = 0)
SELECT a, b, round(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e)) + 1e-8::DOUBLE), 6) AS cosine, round(1 / (1 + list_distance(x.e, y.e)), 6) AS euclid, round(list_dot_product(x.e, y.e), 5) AS dot FROM r JOIN u x ON x.note_id = a JOIN u y ON y.note_id = b""",
}
