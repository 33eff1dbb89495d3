"""Entities under one name: the alias dictionary, normalized entities and triples, the entity registry, pair strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import lookup_join, stage, table
from noteflow.operators.extraction import triples
from noteflow.operators.notes import SQL_NOTES, entity_postings, notes


def alias_table(entries: DataFrame) -> DataFrame:
    """alias, canonical, confidence: every alias and canonical name once. A canonical name stands for itself with 1.0; an
    alias of several entries goes to the one with the largest confidence (0.5 if unknown), ties by name."""
    one = entries.dropDuplicates(["entry_id"]).where(~tx.blank(F.col("canonical_name"))).withColumn("canonical", tx.clean(F.col("canonical_name")))
    own = one.select(F.col("canonical").alias("alias"), "canonical", F.lit(1.0).alias("confidence"))
    told = one.select("canonical", "confidence_scores", F.explode("aliases").alias("a")).where(~tx.blank(F.col("a")))
    told = told.select(tx.clean(F.col("a")).alias("alias"), "canonical", F.coalesce(F.try_element_at("confidence_scores", F.col("a")), F.lit(0.5)).alias("confidence"))
    w = Window.partitionBy("alias").orderBy(F.desc("confidence"), "canonical")
    return own.unionByName(told).withColumn("p", F.row_number().over(w)).where("p = 1").drop("p")


def normalized_entities(n: DataFrame, aliases: DataFrame, least: float = 0.5) -> DataFrame:
    """note_id, entity, canonical, confidence: each entity of a note with its name in the dictionary if the confidence is
    over `least`, else itself with 0. Frequent entities are salted in the join."""
    held = stage(entity_postings(n), "entities")
    j = lookup_join(held, aliases.where(F.col("confidence") > least).withColumnRenamed("alias", "entity"), ["entity"], "left")
    return j.select("note_id", "entity", F.coalesce("canonical", "entity").alias("canonical"), F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"))


def registry(named: DataFrame) -> DataFrame:
    """canonical, variants, mentions, n_notes: the spellings of each entity and how often it occurs."""
    return named.groupBy("canonical").agg(F.count_distinct("entity").alias("variants"), F.count(F.lit(1)).alias("mentions"), F.count_distinct("note_id").alias("n_notes"))


def normalized_triples(t: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triples with subject and object under their names in the dictionary."""
    a = stage(aliases.select("alias", "canonical"), "aliases")
    j = t.join(a.toDF("subject", "s"), "subject", "left").join(a.toDF("object", "o"), "object", "left")
    return j.select("note_id", F.coalesce("s", "subject").alias("subject"), "predicate", F.coalesce("o", "object").alias("object"))


def pair_strength(n: DataFrame) -> DataFrame:
    """note_id, entity_a, entity_b, strength of entity pairs that a note's content holds: 1 less a hundredth of the
    distance between their first places, not below 0, 0.1 more if a word of relation stands in the text, at most 1."""
    own = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: tx.clean(e)), lambda e: e.isNotNull() & (e != ""))))
    t = F.coalesce("content", F.lit(""))
    rows = n.select("note_id", t.alias("t"), own.alias("e")).select("note_id", "t", "e", F.explode("e").alias("entity_a"))
    rows = rows.select("note_id", "t", "entity_a", F.explode(F.filter("e", lambda x: x > F.col("entity_a"))).alias("entity_b"))
    at = lambda c: F.expr(f"instr(t, {c})")
    near = F.greatest(F.lit(0.0), 1 - F.abs(at("entity_a") - at("entity_b")) / 100)
    sign = F.arrays_overlap(tx.tokens(F.col("t")), F.array(*[F.lit(w) for w in SIGNS])).cast("int")
    both = rows.where((at("entity_a") > 0) & (at("entity_b") > 0))
    return both.select("note_id", "entity_a", "entity_b", F.round(F.least(F.lit(1.0), near + 0.1 * sign), 6).alias("strength"))


# Words that state a relation.
SIGNS = ["founded", "built", "succeeded", "published", "received", "worked", "led", "born", "sold", "moved", "joined", "with", "between"]


def source_binding(n: DataFrame) -> DataFrame:
    """file, chunk_index, n_notes, n_texts of chunks that several notes are bound to: more than one text is unstable."""
    rows = n.where(F.col("source_info.file_name").isNotNull()).groupBy(F.col("source_info.file_name").alias("file"), "chunk_index")
    return rows.agg(F.count(F.lit(1)).alias("n_notes"), F.count_distinct(F.md5(F.coalesce("original_text", F.lit("")))).alias("n_texts")).where("n_notes > 1")


def topic_cohesion(n: DataFrame) -> DataFrame:
    """topic, n_notes, cohesion: repeated keywords over different ones among the notes of a title; 1 for a single note,
    0.5 where no note has keywords."""
    base = n.where(~tx.blank(F.col("title"))).select(tx.clean(F.col("title")).alias("topic"), "note_id", "keywords")
    words = base.select("topic", F.explode("keywords").alias("k")).groupBy("topic", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("topic").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("c") > 1).alias("again"))
    out = base.groupBy("topic").agg(F.count(F.lit(1)).alias("n_notes")).join(words, "topic", "left")
    value = F.when(F.col("n_notes") < 2, 1.0).when(F.col("kinds").isNull(), 0.5).otherwise(F.col("again") / F.col("kinds"))
    return out.select("topic", "n_notes", F.round(value, 6).alias("cohesion"))


def _named(s: SparkSession, d: str) -> DataFrame:
    return normalized_entities(notes(s, d), alias_table(table(s, d, "alias_entries")))


QUERIES = {
    "alias_table": lambda s, d: alias_table(table(s, d, "alias_entries")),
    "normalized_entities": _named,
    "entity_registry": lambda s, d: registry(_named(s, d)),
    "normalized_triples": lambda s, d: normalized_triples(triples(notes(s, d), "note_id", "content"), alias_table(table(s, d, "alias_entries"))),
    "entity_pair_strength": lambda s, d: pair_strength(notes(s, d)),
    "source_binding": lambda s, d: source_binding(notes(s, d)),
    "topic_cohesion": lambda s, d: topic_cohesion(notes(s, d)),
}

_BLANK = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '', true)"
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_CLEAN_ENTS = "list_sort(list_distinct(list_filter(list_transform(coalesce(entities, []::VARCHAR[]), lambda e: trim(regexp_replace(e, '\\s+', ' ', 'g'))), lambda e: e IS NOT NULL AND e <> '')))"
_ALIAS = f"""en AS (SELECT * FROM alias_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY entry_id) = 1), al0 AS (SELECT {_CLEAN.format('canonical_name')} AS canonical, aliases, confidence_scores FROM en WHERE NOT {_BLANK.format('canonical_name')}),
al1 AS (SELECT canonical, confidence_scores, unnest(aliases) AS a FROM al0), al2 AS (SELECT canonical AS alias, canonical, 1.0::DOUBLE AS confidence FROM al0 UNION ALL SELECT {_CLEAN.format('a')}, canonical, coalesce(confidence_scores[a], 0.5) FROM al1 WHERE NOT {_BLANK.format('a')}),
al AS (SELECT * FROM al2 QUALIFY row_number() OVER (PARTITION BY alias ORDER BY confidence DESC, canonical) = 1)"""
_NAMED = f"""{SQL_NOTES}, {_ALIAS}, p AS (SELECT note_id, unnest({_CLEAN_ENTS}) AS entity FROM notes),
nm AS (SELECT note_id, entity, coalesce(canonical, entity) AS canonical, round(coalesce(confidence, 0.0), 6) AS confidence FROM p LEFT JOIN (SELECT * FROM al WHERE confidence > 0.5) x ON x.alias = p.entity)"""


def _sql() -> dict[str, str]:
    from noteflow.operators.extraction import SQL as extracted

    triple = extracted["note_triples"]
    head, _, tail = triple.partition("SELECT note_id, trim(a)")
    signs = "[" + ", ".join(f"'{w}'" for w in SIGNS) + "]"
    return {
        "alias_table": f"WITH {_ALIAS} SELECT * FROM al",
        "normalized_entities": f"WITH {_NAMED} SELECT * FROM nm",
        "entity_registry": f"WITH {_NAMED} SELECT canonical, count(DISTINCT entity) AS variants, count(*) AS mentions, count(DISTINCT note_id) AS n_notes FROM nm GROUP BY canonical",
        "normalized_triples": f"""{head.rstrip()}, {_ALIAS}, tr AS (SELECT note_id, trim(a){tail})
SELECT note_id, coalesce(x.canonical, subject) AS subject, predicate, coalesce(y.canonical, object) AS object FROM tr LEFT JOIN al x ON x.alias = subject LEFT JOIN al y ON y.alias = object""",
        "entity_pair_strength": f"""WITH {SQL_NOTES}, e AS (SELECT note_id, coalesce(content, '') AS t, unnest({_CLEAN_ENTS}) AS x FROM notes), j AS (SELECT a.note_id, a.t, a.x AS entity_a, b.x AS entity_b FROM e a JOIN e b ON a.note_id = b.note_id AND a.x < b.x)
SELECT note_id, entity_a, entity_b, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - abs(strpos(t, entity_a) - strpos(t, entity_b)) / 100.0::DOUBLE) + 0.1::DOUBLE * list_has_any(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), {signs})::INT), 6) AS strength
FROM j WHERE strpos(t, entity_a) > 0 AND strpos(t, entity_b) > 0""",
        "source_binding": f"""WITH {SQL_NOTES} SELECT source_info.file_name AS file, chunk_index, count(*) AS n_notes, count(DISTINCT md5(coalesce(original_text, ''))) AS n_texts FROM notes WHERE source_info.file_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
        "topic_cohesion": f"""WITH {SQL_NOTES}, b AS (SELECT {_CLEAN.format('title')} AS topic, note_id, keywords FROM notes WHERE NOT {_BLANK.format('title')}), c AS (SELECT topic, k, count(*) AS c FROM (SELECT topic, unnest(keywords) AS k FROM b) GROUP BY ALL),
w AS (SELECT topic, count(*) AS kinds, count(*) FILTER (WHERE c > 1) AS again FROM c GROUP BY topic), n AS (SELECT topic, count(*) AS n_notes FROM b GROUP BY topic)
SELECT topic, n_notes, round(CASE WHEN n_notes < 2 THEN 1.0 WHEN kinds IS NULL THEN 0.5 ELSE again / kinds::DOUBLE END, 6)::DOUBLE AS cohesion FROM n LEFT JOIN w USING (topic)""",
    }


SQL = _sql()
