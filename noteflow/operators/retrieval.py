"""Candidates of retrieval: hop-wise filters and scores, boosts, ordered unions, quotas, bridges, decomposition, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import stage, table
from noteflow.operators import graph
from noteflow.operators.evaluation import _PA, _QA, _SCORES, items, passages, question_passage_scores
from noteflow.operators.extraction import PATTERNS, masked
from noteflow.operators.graph import SQL_RELATIONS, relations
from noteflow.operators.notes import SQL_NOTES, notes
from noteflow.operators.vectors import _HITS, _hits

# How many pieces of evidence of a type are taken, and words that tell of an event.
QUOTAS = {"semantic_similarity": 5, "reference": 4, "entity_coexistence": 3, "context_relation": 2}
OTHER_QUOTA = 1
EVENTS = {
    "founding": ["founded", "established", "created", "opened"],
    "movement": ["moved", "returned", "left", "carried"],
    "creation": ["built", "rebuilt", "printed", "published", "drew"],
    "transfer": ["sold", "leased", "received", "succeeded"],
    "loss": ["damaged", "lost", "closed", "dismantled", "fell"],
    "life": ["born", "died", "trained"],
}


def hop_candidates(e: DataFrame, derived: DataFrame) -> DataFrame:
    """query, candidate, hop, score: direct neighbours (hop 1) and derived ones (hop 2)."""
    one = e.select(F.col("src").alias("query"), F.col("dst").alias("candidate"), F.lit(1).alias("hop"), F.col("weight").alias("score"))
    return one.unionByName(derived.select(F.col("src").alias("query"), F.col("dst").alias("candidate"), F.lit(2).alias("hop"), F.col("weight").alias("score")))


def hop_filter(c: DataFrame, first: float = 0.2, keep: int = 5, tail: float = 0.1) -> DataFrame:
    """First-hop candidates over `first`; of the second hop the best `keep` whatever their score and the rest over
    `tail`. The final score falls by 0.85 per further hop."""
    w = Window.partitionBy("query", "hop").orderBy(F.desc("score"), "candidate")
    kept = c.withColumn("place", F.row_number().over(w)).where(((F.col("hop") == 1) & (F.col("score") >= first)) | ((F.col("hop") == 2) & ((F.col("place") <= keep) | (F.col("score") >= tail))))
    return kept.select("query", "candidate", "hop", F.round(F.col("score") * F.pow(F.lit(0.85), F.col("hop") - 1), 10).alias("final"))


def boosted(q: DataFrame, p: DataFrame, scores: DataFrame) -> DataFrame:
    """id, idx, hits, score: 0.5 keyword overlap + 0.5 best sentence, times 1.2 for each name of the question that the
    passage holds (2 at most), times 0.6 if it holds none and 0.8 if fewer than half of them."""
    names = F.array_distinct(F.regexp_extract_all(masked(F.col("question")), F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0)))
    j = scores.join(p.select(F.col("item_id").alias("id"), "idx", F.coalesce("paragraph_text", F.lit("")).alias("t")), ["id", "idx"]).join(q.select("id", names.alias("n")), "id")
    hits = F.size(F.filter("n", lambda x: F.contains(F.col("t"), x)))
    j = j.withColumn("hits", hits)
    factor = F.when(F.col("hits") == 0, 0.6).when(F.col("hits") * 2 < F.size("n"), 0.8).otherwise(1.0)
    base = 0.5 * F.col("keyword") + 0.5 * F.col("best_sentence")
    return j.select("id", "idx", "hits", F.round(base * F.least(F.pow(F.lit(1.2), F.col("hits")), F.lit(2.0)) * F.when(F.size("n") == 0, 1.0).otherwise(factor), 6).alias("score"))


def ordered_union(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """query, candidate, tier, place: distinct candidates, all of `primary` before those only in `secondary`, each by
    score. Both: query, candidate, score."""
    both = primary.withColumn("tier", F.lit(1)).unionByName(secondary.withColumn("tier", F.lit(2)))
    best = both.groupBy("query", "candidate").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("m"))
    w = Window.partitionBy("query").orderBy("m", "candidate")
    return best.withColumn("place", F.row_number().over(w)).select("query", "candidate", F.col("m.tier").alias("tier"), "place")


def by_quota(r: DataFrame) -> DataFrame:
    """query, candidate, relation_type, place: the strongest candidates of each type up to its quota."""
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in QUOTAS.items() for x in kv])[F.col("relation_type")], F.lit(OTHER_QUOTA))
    one = r.groupBy(F.col("source_id").alias("query"), F.col("target_id").alias("candidate"), "relation_type").agg(F.max("weight").alias("score"))
    w = Window.partitionBy("query", "relation_type").orderBy(F.desc("score"), "candidate")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(QUOTAS.values())).where(F.col("place") <= quota).select("query", "candidate", "relation_type", "place")


def bridge_entity(n: DataFrame, e: DataFrame) -> DataFrame:
    """query, bridge: the most frequent entity of a note's two strongest neighbours, ties by name."""
    top = graph.strongest_neighbours(e, 2).select(F.col("src").alias("query"), F.col("dst").alias("note_id"))
    held = n.select("note_id", F.explode(F.array_distinct(F.filter("entities", lambda x: F.trim(x) != ""))).alias("entity"))
    c = top.join(held, "note_id").groupBy("query", "entity").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("query").orderBy(F.desc("c"), "entity")
    return c.withColumn("p", F.row_number().over(w)).where("p = 1").select("query", F.col("entity").alias("bridge"))


def cluster_top(n: DataFrame, k: int = 2) -> DataFrame:
    """note_id, place: the k most important notes of each set of entities (none: one general cluster)."""
    key = F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~tx.blank(e)))), "|")
    w = Window.partitionBy("cluster").orderBy(F.desc(F.coalesce("importance_score", F.lit(-1.0))), "note_id")
    return n.select("note_id", "importance_score", key.alias("cluster")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("note_id", "place")


def decompose(q: DataFrame) -> DataFrame:
    """id, part_no, part, priority: a question cut at its conjunctions; parts under three characters are left out, five
    at most stay; the priority is one over the number of parts."""
    parts = F.split(F.coalesce("question", F.lit("")), r"(?:,? (?:and|or|und|oder|et|ou|y|o) |，|、| & )")
    good = F.slice(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.char_length(x) >= 3)), 1, 5)
    return q.select("id", good.alias("g")).select("id", F.size("g").alias("n"), F.posexplode("g").alias("part_no", "part")).select("id", "part_no", "part", F.round(1 / F.col("n"), 6).alias("priority"))


def packed_context(p: DataFrame) -> DataFrame:
    """item_id, digest, length: the passages of an item as [P idx] blocks with empty lines between, by idx."""
    one = p.where(~tx.blank(F.col("paragraph_text"))).select("item_id", F.struct("idx", F.concat(F.lit("[P"), F.col("idx").cast("string"), F.lit("] "), F.trim("paragraph_text")).alias("t")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n")
    return one.groupBy("item_id").agg(text.alias("t")).select("item_id", F.md5("t").alias("digest"), F.char_length("t").alias("length"))


def event_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, event, sentence_no: sentences with a word of an event type, once per type."""
    rows = df.select(key, F.posexplode(tx.sentences(F.col(text))).alias("sentence_no", "s")).withColumn("w", tx.tokens(F.col("s")))
    kinds = F.array_compact(F.array(*[F.when(F.arrays_overlap("w", F.array(*[F.lit(x) for x in words])), F.lit(k)) for k, words in EVENTS.items()]))
    return rows.select(key, F.explode(kinds).alias("event"), "sentence_no")


def event_groups(ev: DataFrame, key: str, gap: int = 2) -> DataFrame:
    """key, event, groups, events: events of a type whose sentences are at most `gap` apart make one group."""
    w = Window.partitionBy(key, "event").orderBy("sentence_no")
    new = (F.col("sentence_no") - F.lag("sentence_no").over(w) > gap).cast("int")
    return ev.withColumn("new", F.coalesce(new, F.lit(1))).groupBy(key, "event").agg(F.sum("new").alias("groups"), F.count(F.lit(1)).alias("events"))


def cited(n: DataFrame) -> DataFrame:
    """source_id, target_id: notes whose content names another note's id in brackets, after @ or after see."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(p), F.lit(1)) for p in (r"\[(note_\w+)\]", r"@(note_\w+)", r"(?:see|siehe|voir|véase|见|参考) ?(note_\w+)")]))
    refs = n.select(F.col("note_id").alias("source_id"), F.explode(F.array_distinct(found)).alias("target_id")).where("source_id != target_id")
    return refs.join(n.select(F.col("note_id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id")


def coverage(n: DataFrame) -> DataFrame:
    """dataset, notes, entities, keywords, files, entity_coverage: different entities over notes, one at most."""
    d = F.split("source_info.file_name", "_")[0]
    base = n.where(F.col("source_info").isNotNull()).select(d.alias("dataset"), "note_id", "entities", "keywords", F.col("source_info.file_name").alias("f"))
    counts = base.groupBy("dataset").agg(F.count(F.lit(1)).alias("notes"), F.count_distinct("f").alias("files"))
    one = lambda c, name: base.select("dataset", F.explode(c).alias("x")).where(~tx.blank(F.col("x"))).groupBy("dataset").agg(F.count_distinct("x").alias(name))
    out = counts.join(one("entities", "entities"), "dataset", "left").join(one("keywords", "keywords"), "dataset", "left").fillna(0)
    return out.withColumn("entity_coverage", F.round(F.least(F.col("entities") / F.col("notes"), F.lit(1.0)), 6))


def joint_grid(scores: DataFrame, p: DataFrame) -> DataFrame:
    """keyword, sentence, f1: for a grid of 81 pairs of thresholds, the F1 of calling a passage supporting that is over both."""
    truth = p.select(F.col("item_id").alias("id"), "idx", F.coalesce("is_supporting", F.lit(False)).alias("t"))
    j = scores.select("id", "idx", "keyword", "best_sentence").join(truth, ["id", "idx"])
    steps = [k / 100 for k in range(2, 20, 2)]
    reached = lambda c: sum(((F.col(c) >= t).cast("int") for t in steps), F.lit(0))
    # at most 100 rows however many passages there are: how many thresholds each of the two scores reaches
    cells = j.groupBy(reached("keyword").alias("k"), reached("best_sentence").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("hits"))
    points = F.array(*[F.struct(F.lit(x).alias("keyword"), F.lit(y).alias("sentence"), ((F.col("k") > i) & (F.col("s") > m)).alias("over")) for i, x in enumerate(steps) for m, y in enumerate(steps)])
    rows = cells.select("n", "hits", F.explode(points).alias("x"))
    sums = rows.groupBy("x.keyword", "x.sentence").agg(F.sum(F.when(F.col("x.over"), F.col("hits")).otherwise(0)).alias("h"), F.sum(F.when(F.col("x.over"), F.col("n")).otherwise(0)).alias("o"), F.sum("hits").alias("true"))
    f1 = F.coalesce(2.0 * F.col("h") / F.nullif(F.col("o") + F.col("true"), F.lit(0)), F.lit(0.0))
    return sums.select("keyword", "sentence", F.round(f1, 6).alias("f1"))


def largest_jump(h: DataFrame, k: int = 5) -> DataFrame:
    """eps, jump: the distance of the k-th neighbour before the largest jump between sorted such distances, within 0.1 and
    2: a radius for density clustering. One row, none for fewer than two queries."""
    d = h.where(F.col("rank") == k).select(F.round(1 - F.col("sim"), 6).alias("d"), "query_id")
    w = Window.orderBy("d", "query_id")  # one row per query of the query set
    j = d.withColumn("jump", F.round(F.lead("d").over(w) - F.col("d"), 6)).where("jump IS NOT NULL")
    return j.orderBy(F.desc("jump"), "d", "query_id").limit(1).select(F.greatest(F.lit(0.1), F.least(F.lit(2.0), "d")).alias("eps"), "jump")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return stage(graph.edges(relations(s, d)), "edges")


def _hop(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    return hop_filter(hop_candidates(e, graph.without_direct(graph.two_hop(e), e)))


def _kind(r: DataFrame, kind: str) -> DataFrame:
    return r.where(F.col("relation_type") == kind).groupBy(F.col("source_id").alias("query"), F.col("target_id").alias("candidate")).agg(F.max("weight").alias("score"))


def _boosted(s: SparkSession, d: str) -> DataFrame:
    q, p = items(s, d), passages(s, d)
    return boosted(q, p, question_passage_scores(q, p))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    r = relations(s, d)
    return ordered_union(_kind(r, "reference"), _kind(r, "semantic_similarity"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return event_groups(event_rows(table(s, d, "documents"), "doc_id", "text"), "doc_id")


def _grid(s: SparkSession, d: str) -> DataFrame:
    q, p = items(s, d), passages(s, d)
    return joint_grid(question_passage_scores(q, p), p)


QUERIES = {
    "hop_filtered": _hop,
    "boosted_passages": _boosted,
    "fallback_union": _ordered,
    "evidence_quota": lambda s, d: by_quota(relations(s, d)),
    "bridge_entities": lambda s, d: bridge_entity(notes(s, d), _edges(s, d)),
    "entity_cluster_top": lambda s, d: cluster_top(notes(s, d)),
    "question_parts": lambda s, d: decompose(items(s, d)),
    "packed_contexts": lambda s, d: packed_context(passages(s, d)),
    "document_events": _events,
    "citation_relations": lambda s, d: cited(notes(s, d)),
    "coverage_metrics": lambda s, d: coverage(notes(s, d)),
    "joint_calibration": _grid,
    "cluster_radius": lambda s, d: largest_jump(_hits(s, d)),
}

_BLANK = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '', true)"
_ENTS = "list_filter(coalesce(entities, []::VARCHAR[]), lambda e: NOT " + _BLANK.format("e") + ")"
_MASKED = "regexp_replace(coalesce({0}, ''), '[^\\x00-\\x7F\\p{{P}}\\p{{Z}}\\p{{S}}]', '_', 'g')"
_SENT = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([。！？.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_E = f"WITH {SQL_RELATIONS}, e AS (SELECT source_id AS src, target_id AS dst, max(weight) AS weight FROM rel GROUP BY ALL)"
_QUOTA = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items()) + f" ELSE {OTHER_QUOTA} END"
_EVENT = " UNION ALL ".join(f"SELECT doc_id, i, '{k}' AS event FROM w WHERE list_has_any(w, [{', '.join(repr(x) for x in v)}])" for k, v in EVENTS.items())
_GRID = ", ".join(f"({k / 100}::DOUBLE, {s / 100}::DOUBLE)" for k in range(2, 20, 2) for s in range(2, 20, 2))

SQL = {
    "hop_filtered": f"""{_E}, d AS (SELECT a.src, b.dst, max(round(a.weight * b.weight * 0.5, 8)) AS weight FROM e a JOIN e b ON a.dst = b.src WHERE a.weight * b.weight * 0.5 > 0.1 AND a.src <> b.dst GROUP BY ALL),
x AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.src = d.src AND e.dst = d.dst) OR (e.src = d.dst AND e.dst = d.src))),
c AS (SELECT src AS query, dst AS candidate, 1 AS hop, weight AS score FROM e UNION ALL SELECT src, dst, 2, weight FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY query, hop ORDER BY score DESC, candidate) AS place FROM c)
SELECT query, candidate, hop, round(score * pow(0.85::DOUBLE, hop - 1), 10) AS final FROM r WHERE (hop = 1 AND score >= 0.2) OR (hop = 2 AND (place <= 5 OR score >= 0.10))""",
    "boosted_passages": f"""WITH {_QA}, {_PA}, {_SCORES}, n AS (SELECT id, list_distinct(regexp_extract_all({_MASKED.format('question')}, '\\b[A-Z][a-z]+\\b')) AS n FROM qa),
h AS (SELECT sc.id, sc.idx, keyword, best_sentence, len(n) AS k, len(list_filter(n, lambda x: contains(coalesce(paragraph_text, ''), x)))::INTEGER AS hits FROM sc JOIN n USING (id) JOIN pa ON pa.item_id = sc.id AND pa.idx = sc.idx)
SELECT id, idx, hits, round((0.5::DOUBLE * keyword + 0.5::DOUBLE * best_sentence) * least(pow(1.2::DOUBLE, hits), 2.0::DOUBLE) * CASE WHEN k = 0 THEN 1.0::DOUBLE WHEN hits = 0 THEN 0.6::DOUBLE WHEN hits * 2 < k THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM h""",
    "fallback_union": f"""WITH {SQL_RELATIONS}, c AS (SELECT source_id AS query, target_id AS candidate, CASE relation_type WHEN 'reference' THEN 1 ELSE 2 END AS tier, max(weight) AS score FROM rel WHERE relation_type IN ('reference', 'semantic_similarity') GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query, candidate ORDER BY tier) = 1) SELECT query, candidate, tier, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, candidate)::INTEGER AS place FROM b""",
    "evidence_quota": f"""WITH {SQL_RELATIONS}, o AS (SELECT source_id AS query, target_id AS candidate, relation_type, max(weight) AS score FROM rel GROUP BY ALL)
SELECT query, candidate, relation_type, row_number() OVER (PARTITION BY query, relation_type ORDER BY score DESC, candidate)::INTEGER AS place FROM o QUALIFY place <= {_QUOTA}""",
    "bridge_entities": f"""{_E}, {SQL_NOTES}, t AS (SELECT src AS query, dst AS note_id FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 2),
h AS (SELECT note_id, unnest(list_distinct(list_filter(entities, lambda x: trim(x) <> ''))) AS entity FROM notes), c AS (SELECT query, entity, count(*) AS c FROM t JOIN h USING (note_id) GROUP BY ALL)
SELECT query, entity AS bridge FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, entity) = 1""",
    "entity_cluster_top": f"""WITH {SQL_NOTES}, c AS (SELECT note_id, importance_score, array_to_string(list_sort(list_distinct({_ENTS})), '|') AS cluster FROM notes)
SELECT note_id, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(importance_score, -1.0) DESC, note_id)::INTEGER AS place FROM c QUALIFY place <= 2""",
    "question_parts": f"""WITH {_QA}, p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(coalesce(question, ''), '(?:,? (?:and|or|und|oder|et|ou|y|o) |，|、| & )'), lambda x: trim(x)), lambda x: length(x) >= 3) AS p FROM qa),
g AS (SELECT id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:5] AS g FROM p), u AS (SELECT id, g, unnest(range(1, len(g) + 1)) AS i FROM g) SELECT id, (i - 1)::INTEGER AS part_no, g[i] AS part, round(1 / len(g)::DOUBLE, 6) AS priority FROM u""",
    "packed_contexts": f"""WITH {_PA}, t AS (SELECT item_id, string_agg('[P' || idx || '] ' || trim(paragraph_text), chr(10) || chr(10) ORDER BY idx) AS t FROM pa WHERE NOT {_BLANK.format('paragraph_text')} GROUP BY item_id)
SELECT item_id, md5(t) AS digest, length(t)::INTEGER AS length FROM t""",
    "document_events": f"""WITH s AS (SELECT doc_id, {_SENT.format('text')} AS s FROM documents), i AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s), w AS (SELECT doc_id, i, regexp_extract_all(lower(s[i]), '[\\p{{L}}\\p{{N}}_]+') AS w FROM i),
ev AS ({_EVENT}), g AS (SELECT *, coalesce((i - lag(i) OVER (PARTITION BY doc_id, event ORDER BY i) > 2)::INT, 1) AS new FROM ev) SELECT doc_id, event, sum(new)::BIGINT AS groups, count(*) AS events FROM g GROUP BY ALL""",
    "citation_relations": f"""WITH {SQL_NOTES}, f AS (SELECT note_id AS source_id, unnest(list_distinct(list_concat(regexp_extract_all(coalesce(content, ''), '\\[(note_\\w+)\\]', 1), regexp_extract_all(coalesce(content, ''), '@(note_\\w+)', 1),
  regexp_extract_all(coalesce(content, ''), '(?:see|siehe|voir|véase|见|参考) ?(note_\\w+)', 1)))) AS target_id FROM notes) SELECT * FROM f WHERE source_id <> target_id AND target_id IN (SELECT note_id FROM notes)""",
    "coverage_metrics": f"""WITH {SQL_NOTES}, b AS (SELECT string_split(source_info.file_name, '_')[1] AS dataset, source_info.file_name AS f, entities, keywords FROM notes WHERE source_info IS NOT NULL),
e AS (SELECT dataset, count(DISTINCT x) AS entities FROM (SELECT dataset, unnest(entities) AS x FROM b) WHERE NOT {_BLANK.format('x')} GROUP BY dataset), k AS (SELECT dataset, count(DISTINCT x) AS keywords FROM (SELECT dataset, unnest(keywords) AS x FROM b) WHERE NOT {_BLANK.format('x')} GROUP BY dataset),
c AS (SELECT dataset, count(*) AS notes, count(DISTINCT f) AS files FROM b GROUP BY dataset) SELECT dataset, notes, files, coalesce(entities, 0) AS entities, coalesce(keywords, 0) AS keywords, round(least(coalesce(entities, 0) / notes::DOUBLE, 1.0), 6) AS entity_coverage FROM c LEFT JOIN e USING (dataset) LEFT JOIN k USING (dataset)""",
    "joint_calibration": f"""WITH {_QA}, {_PA}, {_SCORES}, j AS (SELECT sc.keyword AS kw, best_sentence AS bs, coalesce(is_supporting, false) AS t FROM sc JOIN pa ON sc.id = pa.item_id AND sc.idx = pa.idx), g(keyword, sentence) AS (VALUES {_GRID})
SELECT keyword, sentence, round(coalesce(2.0::DOUBLE * count(*) FILTER (WHERE kw >= keyword AND bs >= sentence AND t) / nullif(count(*) FILTER (WHERE kw >= keyword AND bs >= sentence) + count(*) FILTER (WHERE t), 0), 0.0), 6) AS f1 FROM j, g GROUP BY keyword, sentence""",
    "cluster_radius": f"""WITH {_HITS.replace(') AS sim,', ') AS sim,')}, r AS (SELECT query_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM hits), d AS (SELECT round(1 - sim, 6) AS d, query_id FROM r WHERE rank = 5),
j AS (SELECT d, query_id, round(lead(d) OVER (ORDER BY d, query_id) - d, 6) AS jump FROM d) SELECT greatest(0.1::DOUBLE, least(2.0::DOUBLE, d)) AS eps, jump FROM j WHERE jump IS NOT NULL ORDER BY jump DESC, d, query_id LIMIT 1""",
}
