"""Operators on notes and documents: text projections, chunks, quality filters, duplicates, entity index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import lookup_join, stage, table
from noteflow.operators.references import latest


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atomic_notes, each note once as delivered last, deleted ones left out."""
    return latest(table(spark, sf_dir, "atomic_notes"), ["note_id"]).where(F.col("deleted_at").isNull())


SQL_NOTES = """notes AS (SELECT * FROM (SELECT * FROM atomic_notes QUALIFY row_number() OVER
  (PARTITION BY note_id ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL)"""


def pick_text(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, text, picked_from: the first of `columns` that is not blank; null where all are."""
    pick = lambda value: F.coalesce(*[F.when(~tx.blank(F.col(c)), value(c)) for c in columns])
    return df.select(key, pick(F.col).alias("text"), pick(F.lit).alias("picked_from"))


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence_no, sentence; null and blank texts give no rows."""
    return df.select(key, F.posexplode(tx.sentences(F.col(text))).alias("sentence_no", "sentence"))


def chunk_rows(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 0) -> DataFrame:
    """key, chunk_no, chunk: sentences packed to `size` characters."""
    return df.select(key, F.posexplode(tx.chunk_by_length(F.col(text), size, overlap)).alias("chunk_no", "chunk"))


def chunk_size(length):
    """Chunk size by text length: short texts stay whole, longer ones get larger chunks."""
    return F.when(length < 1000, length).when(length < 5000, 500).when(length < 20000, 1000).otherwise(1500)


def valid_chunks(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has 10 characters or more, at least 0.3 of them letters or digits."""
    return df.where((F.char_length(F.trim(text)) >= 10) & (tx.alnum_ratio(F.col(text)) >= 0.3))


def embedding_text(df: DataFrame, limit: int = 512):
    """title | content | ENTITIES: a, b - the last `limit` characters of it; a stand-in for less than 3 characters."""
    named = F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~tx.blank(e))
    parts = F.concat_ws(
        " | ", F.when(~tx.blank(F.col("title")), F.col("title")), F.when(~tx.blank(F.col("content")), F.col("content")),
        F.when(F.size(named) > 0, F.concat(F.lit("ENTITIES: "), F.array_join(named, ", "))),
    )
    return df.withColumn("embedding_text", F.when(F.char_length(F.trim(parts)) < 3, F.lit("Empty note")).otherwise(F.right(parts, F.lit(limit))))


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_id (md5 of the text), first_key, copies: members of groups of equal texts. Groups are counted first
    and joined back with hot texts salted, so one text may fill a third of the table."""
    marked = stage(df.where(F.col(text).isNotNull()).select(key, F.md5(text).alias("class_id")), "text-classes")
    groups = marked.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key")).where("copies > 1")
    return lookup_join(marked, groups, ["class_id"]).select(key, "class_id", "first_key", "copies")


def signature(c):
    """The first and last ten normalized words, all of them if there are twenty or fewer."""
    w = F.filter(F.split(tx.normalize(c), " "), lambda x: x != "")
    return F.array_join(F.when(F.size(w) <= 20, w).otherwise(F.concat(F.slice(w, 1, 10), F.slice(w, -10, 10))), " ")


def entity_postings(df: DataFrame) -> DataFrame:
    """note_id, entity: each trimmed entity of a note once."""
    return df.select("note_id", F.explode(F.array_distinct(F.transform("entities", lambda e: tx.clean(e)))).alias("entity")).where("entity != ''")


def top_terms(df: DataFrame, group: str, term: str, k: int = 10) -> DataFrame:
    """group, term, n, share, rank: the k most frequent terms of each group; ties by term."""
    counted = df.groupBy(group, term).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(group)
    return (
        counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6))
        .withColumn("rank", F.row_number().over(total.orderBy(F.desc("n"), term))).where(F.col("rank") <= k)
    )


def per_chunk_limit(df: DataFrame, most: int = 12) -> DataFrame:
    """At most `most` notes of each chunk of a file: the most important, ties by note_id."""
    w = Window.partitionBy("source_info.file_name", "chunk_index").orderBy(F.desc(F.coalesce("importance_score", F.lit(-1.0))), "note_id")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def entity_pair_counts(df: DataFrame, least: int = 3) -> DataFrame:
    """entity_a, entity_b, n: how many notes hold both; pairs inside a note only, counted map-side."""
    own = F.array_sort(F.array_distinct(F.filter(F.transform("entities", lambda e: tx.clean(e)), lambda e: e.isNotNull() & (e != ""))))
    rows = df.select("note_id", own.alias("e")).select("note_id", "e", F.explode("e").alias("entity_a"))
    pairs = rows.select("entity_a", F.explode(F.filter("e", lambda x: x > F.col("entity_a"))).alias("entity_b"))
    return pairs.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def shared_entity_pairs(df: DataFrame) -> DataFrame:
    """note_a, note_b, shared, jaccard, weight of notes that share two entities or more. The join key is a pair of entities,
    not one entity: an entity that is everywhere makes no pairs by itself."""
    own = F.array_sort(F.array_distinct(F.filter(F.transform("entities", lambda e: tx.clean(e)), lambda e: e.isNotNull() & (e != ""))))
    rows = df.select("note_id", own.alias("e")).where(F.size("e") >= 2)
    keyed = rows.select("note_id", "e", F.size("e").alias("n"), F.explode("e").alias("x")).select("note_id", "n", "x", F.explode(F.filter("e", lambda y: y > F.col("x"))).alias("y"))
    keyed = stage(keyed, "entity-pairs")
    a, b = (keyed.select(F.col("note_id").alias(f"note_{k}"), F.col("n").alias(f"n_{k}"), "x", "y") for k in "ab")
    both = a.join(b, ["x", "y"]).where("note_a < note_b").groupBy("note_a", "note_b").agg(F.count(F.lit(1)).alias("pairs"), (F.first("n_a") + F.first("n_b")).alias("sizes"))
    # s shared entities make s (s - 1) / 2 shared pairs
    shared = ((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("int")
    return both.select("note_a", "note_b", shared.alias("shared"), F.round(shared / (F.col("sizes") - shared), 6).alias("jaccard"), F.round(0.8 * F.least(shared / 5, F.lit(1.0)), 6).alias("weight"))


def context_pairs(df: DataFrame, reach: int = 3) -> DataFrame:
    """note_a, note_b, distance, weight 0.6 / distance of notes at most `reach` places apart in their file, in both directions."""
    w = Window.partitionBy("file").orderBy("chunk_index", "note_id")
    rows = df.select("note_id", F.col("source_info.file_name").alias("file"), "chunk_index").where(F.col("file").isNotNull())
    ahead = F.array(*[F.struct(F.lead("note_id", d).over(w).alias("note_b"), F.lit(d).alias("distance")) for d in range(1, reach + 1)])
    pairs = rows.withColumn("ahead", ahead).select(F.col("note_id").alias("note_a"), F.explode("ahead").alias("x")).select("note_a", "x.note_b", "x.distance").where("note_b IS NOT NULL")
    back = pairs.select(F.col("note_b").alias("note_a"), F.col("note_a").alias("note_b"), "distance")
    return pairs.unionByName(back).withColumn("weight", F.round(0.6 / F.col("distance"), 6))


def sentence_coverage(df: DataFrame, least: float = 0.6) -> DataFrame:
    """chunk_key, sentence_no, best, covered: how well the notes of a chunk cover its sentences (word-set Jaccard)."""
    live = df.where(~tx.blank(F.col("original_text"))).withColumn("chunk_key", F.md5("original_text"))
    chunks = live.groupBy("chunk_key").agg(F.first("original_text").alias("original_text"))
    said = live.select("chunk_key", F.explode(tx.sentences(F.col("content"))).alias("said")).distinct()
    said = said.groupBy("chunk_key").agg(F.collect_list(tx.word_set(F.col("said"))).alias("sets"))
    rows = sentence_rows(chunks, "chunk_key", "original_text").join(said, "chunk_key", "left")
    best = F.coalesce(F.array_max(F.transform("sets", lambda s: tx.jaccard(tx.word_set(F.col("sentence")), s))), F.lit(0.0))
    return rows.select("chunk_key", "sentence_no", F.round(best, 6).alias("best"), (best >= least).alias("covered"))


def traceability(df: DataFrame) -> DataFrame:
    """note_id, n_entities, n_found, missing_ratio, flagged: entities of a note that its chunk does not hold."""
    ents = F.array_distinct(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~tx.blank(e)))
    t = F.lower(F.coalesce("original_text", F.lit("")))
    rows = df.select("note_id", ents.alias("e"), t.alias("t")).select(
        "note_id", F.size("e").alias("n_entities"), F.size(F.filter("e", lambda x: F.contains(F.col("t"), F.lower(x)))).alias("n_found")
    )
    ratio = F.when(F.col("n_entities") > 0, 1 - F.col("n_found") / F.col("n_entities")).otherwise(F.lit(0.0))
    return rows.withColumn("missing_ratio", F.round(ratio, 6)).withColumn("flagged", F.col("missing_ratio") > 0.3)


def _q(make):
    return lambda spark, d: make(notes(spark, d))


QUERIES = {
    "note_text_pick": _q(lambda n: pick_text(n, ["original_text", "content", "title"], "note_id")),
    "document_sentences": lambda s, d: sentence_rows(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.max(F.char_length("sentence")).alias("longest")),
    "note_clean_text": _q(lambda n: n.select("note_id", tx.clean(F.col("content")).alias("cleaned"), tx.normalize(F.col("content")).alias("normalized"))),
    "document_chunk_size": lambda s, d: table(s, d, "documents").select("doc_id", chunk_size(F.char_length(F.coalesce("text", F.lit("")))).alias("chunk_size")),
    "document_chunks": lambda s, d: chunk_rows(table(s, d, "documents"), "doc_id", "text"),
    "valid_passages": lambda s, d: valid_chunks(latest(table(s, d, "paragraphs"), ["item_id", "idx"]), "paragraph_text").groupBy("is_supporting").agg(F.count(F.lit(1)).alias("n")),
    "note_embedding_text": _q(lambda n: embedding_text(n).select("note_id", "embedding_text")),
    "document_exact_duplicates": lambda s, d: exact_duplicates(table(s, d, "documents"), "doc_id", "text"),
    "note_signature": _q(lambda n: n.select("note_id", signature(F.coalesce("content", F.lit(""))).alias("signature"))),
    "entity_index": _q(lambda n: entity_postings(n).groupBy("entity").agg(F.count(F.lit(1)).alias("note_count"), F.min("note_id").alias("first_note"))),
    "entity_index_info": _q(lambda n: entity_postings(n).groupBy("entity").agg(F.count(F.lit(1)).alias("c")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("c").alias("postings"), F.round(F.avg("c"), 6).alias("avg_notes"))),
    "top_keywords": _q(lambda n: top_terms(n.select(F.split("source_info.file_name", "_")[0].alias("dataset"), F.explode("keywords").alias("keyword")).where("dataset IS NOT NULL"), "dataset", "keyword")),
    "notes_per_chunk": _q(lambda n: per_chunk_limit(n).select("note_id", "place")),
    "entity_cooccurrence": _q(entity_pair_counts),
    "entity_coexistence": _q(shared_entity_pairs),
    "context_relations": _q(context_pairs),
    "sentence_coverage": _q(sentence_coverage),
    "entity_traceability": _q(traceability),
    "namespace_stats": _q(lambda n: n.groupBy(F.coalesce(F.split(F.lower("source_info.file_name"), "_")[0], F.lit("none")).alias("dataset")).agg(
        F.count(F.lit(1)).alias("notes"), F.count_distinct("source_info.file_name").alias("files"), F.round(F.avg(F.char_length("content")), 6).alias("avg_length"))),
    "processing_stats": _q(lambda n: n.agg(
        F.count(F.lit(1)).alias("notes"), F.count_distinct("source_info.file_name").alias("files"), F.count_distinct(F.struct("source_info.file_name", "chunk_index")).alias("chunks"),
        F.round(F.avg(F.char_length("content")), 6).alias("avg_length"))),
    "best_of_entity_set": _q(lambda n: n.withColumn("k", F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~tx.blank(e)))), "|")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(F.coalesce("importance_score", F.lit(-1.0)).alias("i"), "note_id")).alias("m")).select(F.col("k").alias("entity_set"), "n", F.col("m.note_id").alias("best_note"))),
    "adaptive_threshold": _q(lambda n: n.crossJoin(F.broadcast(n.agg((F.avg("importance_score") - 0.5 * F.stddev_pop("importance_score")).alias("t")))).where(
        F.col("importance_score") >= F.greatest(F.lit(0.3), F.round("t", 6))).select("note_id", F.round("importance_score", 6).alias("importance"))),
    "keyword_entropy": _q(lambda n: n.select(F.split("source_info.file_name", "_")[0].alias("dataset"), F.explode("keywords").alias("k")).where("dataset IS NOT NULL").groupBy("dataset", "k").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("dataset"))).groupBy("dataset").agg(F.count(F.lit(1)).alias("kinds"), F.round(F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("p") * F.log2("p")) / F.log2(F.count(F.lit(1)))).otherwise(0.0), 6).alias("entropy"))),
}

_BLANK = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '', true)"
_ENTS = "list_filter(coalesce(entities, []::VARCHAR[]), lambda e: NOT " + _BLANK.format("e") + ")"
_CLEAN_ENTS = "list_sort(list_distinct(list_filter(list_transform(coalesce(entities, []::VARCHAR[]), lambda e: trim(regexp_replace(e, '\\s+', ' ', 'g'))), lambda e: e IS NOT NULL AND e <> '')))"
_SENT = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([。！？.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+')), lambda w: w <> '')"
_JACC = "CASE WHEN len({0}) + len({1}) - len(list_intersect({0}, {1})) > 0 THEN len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE ELSE 0.0 END"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"
_W = f"WITH {SQL_NOTES}"

SQL = {
    "note_text_pick": f"""{_W} SELECT note_id,
  CASE WHEN NOT {_BLANK.format('original_text')} THEN original_text WHEN NOT {_BLANK.format('content')} THEN content WHEN NOT {_BLANK.format('title')} THEN title END AS text,
  CASE WHEN NOT {_BLANK.format('original_text')} THEN 'original_text' WHEN NOT {_BLANK.format('content')} THEN 'content' WHEN NOT {_BLANK.format('title')} THEN 'title' END AS picked_from FROM notes""",
    "document_sentences": f"""SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents) GROUP BY doc_id""",
    "note_clean_text": f"""{_W} SELECT note_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS cleaned, {_NORM.format('content')} AS normalized FROM notes""",
    "document_chunk_size": """SELECT doc_id, CASE WHEN n < 1000 THEN n WHEN n < 5000 THEN 500 WHEN n < 20000 THEN 1000 ELSE 1500 END::INTEGER AS chunk_size FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)""",
    "valid_passages": """SELECT is_supporting, count(*) AS n FROM (SELECT * FROM paragraphs QUALIFY row_number() OVER (PARTITION BY item_id, idx ORDER BY ingested_at DESC NULLS LAST) = 1)
WHERE length(trim(paragraph_text)) >= 10 AND length(regexp_replace(paragraph_text, '[^\\p{L}\\p{N}]', '', 'g')) / length(paragraph_text)::DOUBLE >= 0.3 GROUP BY is_supporting""",
    "note_embedding_text": f"""{_W}, j AS (SELECT note_id, concat_ws(' | ', CASE WHEN NOT {_BLANK.format('title')} THEN title END, CASE WHEN NOT {_BLANK.format('content')} THEN content END,
  CASE WHEN len({_ENTS}) > 0 THEN 'ENTITIES: ' || array_to_string({_ENTS}, ', ') END) AS t FROM notes)
SELECT note_id, CASE WHEN length(trim(t)) < 3 THEN 'Empty note' ELSE right(t, 512) END AS embedding_text FROM j""",
    "document_exact_duplicates": """SELECT doc_id, class_id, first_key, copies FROM (SELECT doc_id, md5(text) AS class_id, min(doc_id) OVER w AS first_key, count(*) OVER w AS copies
FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY md5(text))) WHERE copies > 1""",
    "note_signature": f"""{_W}, w AS (SELECT note_id, list_filter(string_split({_NORM.format("coalesce(content, '')")}, ' '), lambda x: x <> '') AS w FROM notes)
SELECT note_id, array_to_string(CASE WHEN len(w) <= 20 THEN w ELSE list_concat(w[1:10], w[-10:]) END, ' ') AS signature FROM w""",
    "entity_index": f"""{_W}, p AS (SELECT note_id, unnest({_CLEAN_ENTS}) AS entity FROM notes) SELECT entity, count(*) AS note_count, min(note_id) AS first_note FROM p GROUP BY entity""",
    "entity_index_info": f"""{_W}, p AS (SELECT note_id, unnest({_CLEAN_ENTS}) AS entity FROM notes), c AS (SELECT entity, count(*) AS c FROM p GROUP BY entity)
SELECT count(*) AS entities, sum(c)::BIGINT AS postings, round(avg(c), 6) AS avg_notes FROM c""",
    "top_keywords": f"""{_W}, k AS (SELECT string_split(source_info.file_name, '_')[1] AS dataset, unnest(keywords) AS keyword FROM notes), c AS (SELECT dataset, keyword, count(*) AS n FROM k WHERE dataset IS NOT NULL GROUP BY dataset, keyword)
SELECT dataset, keyword, n, round(n / sum(n) OVER (PARTITION BY dataset), 6)::DOUBLE AS share, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, keyword)::INTEGER AS rank FROM c QUALIFY rank <= 10""",
    "notes_per_chunk": f"""{_W} SELECT note_id, row_number() OVER (PARTITION BY source_info.file_name, chunk_index ORDER BY coalesce(importance_score, -1.0) DESC, note_id)::INTEGER AS place FROM notes QUALIFY place <= 12""",
    "entity_cooccurrence": f"""{_W}, p AS (SELECT note_id, {_CLEAN_ENTS} AS e FROM notes), x AS (SELECT note_id, unnest(e) AS entity FROM p)
SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM x a JOIN x b ON a.note_id = b.note_id AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 3""",
    "entity_coexistence": f"""{_W}, e AS (SELECT note_id, {_CLEAN_ENTS} AS e FROM notes), x AS (SELECT note_id, len(e) AS n, unnest(e) AS entity FROM e)
SELECT a.note_id AS note_a, b.note_id AS note_b, count(*)::INTEGER AS shared, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE, 6) AS jaccard, round(0.8 * least(count(*) / 5.0::DOUBLE, 1.0), 6) AS weight
FROM x a JOIN x b ON a.entity = b.entity AND a.note_id < b.note_id GROUP BY a.note_id, b.note_id HAVING count(*) >= 2""",
    "context_relations": f"""{_W}, r AS (SELECT note_id, source_info.file_name AS file, row_number() OVER (PARTITION BY source_info.file_name ORDER BY chunk_index, note_id) AS k FROM notes WHERE source_info.file_name IS NOT NULL)
SELECT a.note_id AS note_a, b.note_id AS note_b, abs(b.k - a.k)::INTEGER AS distance, round(0.6 / abs(b.k - a.k), 6)::DOUBLE AS weight FROM r a JOIN r b ON a.file = b.file AND abs(b.k - a.k) BETWEEN 1 AND 3""",
    "sentence_coverage": f"""{_W}, live AS (SELECT md5(original_text) AS chunk_key, original_text, content FROM notes WHERE NOT {_BLANK.format('original_text')}),
said AS (SELECT DISTINCT chunk_key, unnest({_SENT.format('content')}) AS s FROM live), sets AS (SELECT chunk_key, {_WORDS.format('s')} AS w FROM said),
c AS (SELECT DISTINCT chunk_key, original_text FROM live), l AS (SELECT chunk_key, {_SENT.format('original_text')} AS ss FROM c),
r AS (SELECT chunk_key, i - 1 AS sentence_no, {_WORDS.format('ss[i]')} AS v FROM (SELECT chunk_key, ss, unnest(range(1, len(ss) + 1)) AS i FROM l)),
b AS (SELECT r.chunk_key, sentence_no, coalesce(max({_JACC.format('v', 'w')}), 0.0) AS best FROM r LEFT JOIN sets USING (chunk_key) GROUP BY ALL)
SELECT chunk_key, sentence_no::INTEGER AS sentence_no, round(best, 6) AS best, best >= 0.6 AS covered FROM b""",
    "entity_traceability": f"""{_W}, r AS (SELECT note_id, len(list_distinct({_ENTS}))::INTEGER AS n_entities, len(list_filter(list_distinct({_ENTS}), lambda x: contains(lower(coalesce(original_text, '')), lower(x))))::INTEGER AS n_found FROM notes),
m AS (SELECT *, round(CASE WHEN n_entities > 0 THEN 1 - n_found / n_entities::DOUBLE ELSE 0.0 END, 6) AS missing_ratio FROM r) SELECT *, missing_ratio > 0.3 AS flagged FROM m""",
    "namespace_stats": f"""{_W} SELECT coalesce(string_split(lower(source_info.file_name), '_')[1], 'none') AS dataset, count(*) AS notes, count(DISTINCT source_info.file_name) AS files, round(avg(length(content)), 6) AS avg_length FROM notes GROUP BY 1""",
    "processing_stats": f"""{_W} SELECT count(*) AS notes, count(DISTINCT source_info.file_name) AS files, (SELECT count(*) FROM (SELECT DISTINCT source_info.file_name, chunk_index FROM notes)) AS chunks, round(avg(length(content)), 6) AS avg_length FROM notes""",
    "best_of_entity_set": f"""{_W}, k AS (SELECT array_to_string(list_sort(list_distinct({_ENTS})), '|') AS entity_set, note_id, coalesce(importance_score, -1.0) AS i FROM notes)
SELECT entity_set, count(*) AS n, arg_max(note_id, (i, note_id)) AS best_note FROM k GROUP BY entity_set""",
    "adaptive_threshold": f"""{_W} SELECT note_id, round(importance_score, 6) AS importance FROM notes WHERE importance_score >= greatest(0.3, round((SELECT avg(importance_score) - 0.5 * stddev_pop(importance_score) FROM notes), 6))""",
    "keyword_entropy": f"""{_W}, k AS (SELECT string_split(source_info.file_name, '_')[1] AS dataset, unnest(keywords) AS k FROM notes), c AS (SELECT dataset, k, count(*) AS c FROM k WHERE dataset IS NOT NULL GROUP BY ALL),
p AS (SELECT dataset, c / sum(c) OVER (PARTITION BY dataset)::DOUBLE AS p FROM c) SELECT dataset, count(*) AS kinds, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0.0 END, 6) AS entropy FROM p GROUP BY dataset""",
}
