"""Reasoning over the passages of a question and over edges: passage graphs, hops needed, spans, features, beams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import stage
from noteflow.operators import graph
from noteflow.operators.evaluation import _PA, _QA, items, passages
from noteflow.operators.extraction import PATTERNS, found, masked
from noteflow.operators.graph import SQL_RELATIONS, relations

NAME = r"\b[A-Z][a-z]+\b"


def passage_graph(p: DataFrame, least: float = 0.3) -> DataFrame:
    """item_id, a, b, weight: passages of one item whose words overlap over `least`, or their names over 0.2; the larger
    overlap is the weight. Pairs are made inside items only, which are small."""
    rows = p.select("item_id", "idx", tx.word_set(F.col("paragraph_text"), tx.STOP_WORDS).alias("w"), found(F.col("paragraph_text"), NAME).alias("n"))
    a = rows.toDF("item_id", "a", "wa", "na")
    b = rows.toDF("item_id", "b", "wb", "nb")
    words, names = tx.jaccard(F.col("wa"), F.col("wb")), tx.jaccard(F.col("na"), F.col("nb"))
    pairs = a.join(b, "item_id").where("a < b").select("item_id", "a", "b", words.alias("x"), names.alias("y"))
    return pairs.where((F.col("x") > least) | (F.col("y") > 0.2)).select("item_id", "a", "b", F.round(F.greatest("x", "y"), 6).alias("weight"))


def anchors(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, question_idx, answer_idx: the passage that shares most words with the question, and the first that holds the
    answer (null if none does); ties go to the earlier passage."""
    j = p.select(F.col("item_id").alias("id"), "idx", "paragraph_text").join(q.select("id", "question", "predicted_answer"), "id")
    near = tx.jaccard(tx.word_set(F.col("question"), tx.STOP_WORDS), tx.word_set(F.col("paragraph_text"), tx.STOP_WORDS))
    answer = F.lower(F.trim(F.coalesce("predicted_answer", F.lit(""))))
    holds = (answer != "") & F.contains(F.lower(F.coalesce("paragraph_text", F.lit(""))), answer)
    return j.groupBy("id").agg(F.max(F.struct(F.round(near, 9).alias("s"), (-F.col("idx")).alias("i"))).alias("m"), F.min(F.when(holds, F.col("idx"))).alias("answer_idx")).select("id", (-F.col("m.i")).alias("question_idx"), "answer_idx")


def hops_needed(a: DataFrame, g: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """id, k: passages on the shortest path from the question's passage to the answer's, between `least` and `most`;
    `least` where either is unknown, `most` where no path of that length joins them."""
    both = stage(g.select(F.col("item_id").alias("id"), "a", "b").union(g.select("item_id", "b", "a")), "passage-edges")
    front = a.where("answer_idx IS NOT NULL").select("id", F.col("question_idx").alias("at"), "answer_idx")
    out = front.where("at = answer_idx").select("id", F.lit(1).alias("n"))
    for step in range(2, most + 1):
        front = stage(front.join(both, (front.id == both.id) & (front["at"] == both.a)).select(front.id, F.col("b").alias("at"), "answer_idx").distinct(), "passage-front")
        out = out.unionByName(front.where("at = answer_idx").select("id", F.lit(step).alias("n")))
    short = out.groupBy("id").agg(F.min("n").alias("n"))
    k = F.when(F.col("answer_idx").isNull(), F.lit(least)).otherwise(F.greatest(F.lit(least), F.coalesce("n", F.lit(most))))
    return a.join(short, "id", "left").select("id", k.cast("int").alias("k"))


def spans(p: DataFrame) -> DataFrame:
    """item_id, idx, kind, span: quoted spans, years, numbers and names of each passage, each once per kind."""
    kinds = {"quoted": r"\"[^\"]{2,60}\"", "year": PATTERNS["year"], "number": PATTERNS["number"], "name": PATTERNS["name"]}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), found(F.col("paragraph_text"), r).alias("s")) for k, r in kinds.items()])
    return p.select("item_id", "idx", F.explode(rows).alias("x")).select("item_id", "idx", "x.kind", F.explode("x.s").alias("span"))


def best_span(q: DataFrame, s: DataFrame) -> DataFrame:
    """id, span, kind: for questions of when and how many a year or number, for who and where a name that the question
    lacks; the span in most passages, ties by text."""
    low = F.lower(F.coalesce("question", F.lit("")))
    want = F.when(low.rlike(r"^(when|in which year|what year)\b"), "year").when(low.rlike(r"^how many\b"), "number").when(low.rlike(r"^(who|where)\b"), "name")
    j = q.select("id", masked(F.col("question")).alias("question"), want.alias("kind")).where("kind IS NOT NULL").join(s.withColumnRenamed("item_id", "id"), ["id", "kind"])
    c = j.where(~F.contains("question", F.col("span"))).groupBy("id", "kind", "span").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "span")
    return c.withColumn("p", F.row_number().over(w)).where("p = 1").select("id", "span", "kind")


def question_flags(c: Column) -> list[Column]:
    """0/1 flags of the question words."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return [low.rlike(rf"\b{w}\b").cast("int").alias(w.replace(" ", "_")) for w in ("who", "what", "when", "where", "why", "how many")]


def answer_features(q: DataFrame) -> DataFrame:
    """id, question flags, has_number, has_year, has_name, n_words and overlap of answer and question."""
    a = F.col("predicted_answer")
    return q.select(
        "id", *question_flags(F.col("question")), masked(a).rlike(r"[0-9]").cast("int").alias("has_number"), masked(a).rlike(PATTERNS["year"]).cast("int").alias("has_year"),
        masked(a).rlike(PATTERNS["name"]).cast("int").alias("has_name"), F.size(tx.tokens(a)).alias("n_words"), F.round(tx.jaccard(tx.word_set(F.col("question")), tx.word_set(a)), 6).alias("overlap"),
    )


def beam_search(e: DataFrame, seeds: DataFrame, most_hops: int = 4, beam: int = 8, branch: int = 6) -> DataFrame:
    """seed, path, score: the `beam` best paths of each length per seed; weights add up, no node comes twice, at most
    `branch` ways on from a node."""
    e = stage(graph.strongest_neighbours(e, branch).select("src", "dst", "weight"), "branches")
    paths = seeds.select(F.col("node").alias("seed"), F.array("node").alias("path"), F.lit(0.0).alias("score"))
    out = None
    w = Window.partitionBy("seed").orderBy(F.desc("score"), F.array_join("path", ">"))
    for _ in range(most_hops):
        ahead = paths.withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst")))
        ahead = ahead.select("seed", F.array_append("path", F.col("dst")).alias("path"), F.round(F.col("score") + F.col("weight"), 6).alias("score"))
        paths = stage(ahead.withColumn("n", F.row_number().over(w)).where(F.col("n") <= beam).drop("n"), "beam")
        out = paths if out is None else out.unionByName(paths)
    return out


def nearest_by_weight(e: DataFrame, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """node, distance: the least sum of 1 - weight from any seed over at most `rounds` edges (Bellman-Ford)."""
    best = stage(seeds.select("node").distinct().withColumn("distance", F.lit(0.0)), "distances")
    for _ in range(rounds):
        step = e.join(best.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.round(F.col("distance") + 1 - F.col("weight"), 6).alias("distance"))
        best = stage(best.unionByName(step).groupBy("node").agg(F.min("distance").alias("distance")), "distances")
    return best


def validate_spans(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, n_named, n_holding, valid: of the passages an answer names, how many hold it; valid if one does."""
    named = q.select("id", F.lower(F.trim(F.coalesce("predicted_answer", F.lit("")))).alias("a"), F.explode(F.array_distinct("predicted_support_idxs")).alias("idx")).where("idx IS NOT NULL")
    j = named.join(p.select(F.col("item_id").alias("id"), "idx", F.lower(F.coalesce("paragraph_text", F.lit(""))).alias("t")), ["id", "idx"], "left")
    holds = (F.col("a") != "") & F.contains("t", F.col("a"))
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("n_named"), F.count_if(holds).alias("n_holding")).withColumn("valid", F.col("n_holding") > 0)


def _qp(make):
    return lambda s, d: make(items(s, d), passages(s, d))


def _e(make):
    def run(s: SparkSession, d: str) -> DataFrame:
        e = stage(graph.edges(relations(s, d)), "edges")
        return make(e, graph._seeds(e))

    return run


QUERIES = {
    "passage_graph": _qp(lambda q, p: passage_graph(p)),
    "passage_anchors": _qp(anchors),
    "hops_needed": _qp(lambda q, p: hops_needed(stage(anchors(q, p), "anchors"), passage_graph(p))),
    "passage_spans": _qp(lambda q, p: spans(p)),
    "best_span": _qp(lambda q, p: best_span(q, spans(p))),
    "answer_features": _qp(lambda q, p: answer_features(q)),
    "answer_validation": _qp(validate_spans),
    "beam_paths": _e(lambda e, n: beam_search(e, n).select("seed", F.array_join("path", ">").alias("path"), "score")),
    "weighted_neighbourhood": _e(nearest_by_weight),
}

_W = f"WITH {_QA}, {_PA}"
_STOPS = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_KEY = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+')), lambda w: w <> '' AND NOT list_contains(" + _STOPS + ", w))"
_ALL = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+')), lambda w: w <> '')"
_MASKED = "regexp_replace(coalesce({0}, ''), '[^\\x00-\\x7F\\p{{P}}\\p{{Z}}\\p{{S}}]', '_', 'g')"


def _j(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) - {n} > 0 THEN {n} / (len({a}) + len({b}) - {n})::DOUBLE ELSE 0.0 END"


_GRAPH = f"""r AS (SELECT item_id, idx, {_KEY.format('paragraph_text')} AS w, list_distinct(regexp_extract_all({_MASKED.format('paragraph_text')}, '\\b[A-Z][a-z]+\\b')) AS n FROM pa),
x AS (SELECT a.item_id, a.idx AS a, b.idx AS b, {_j('a.w', 'b.w')} AS x, {_j('a.n', 'b.n')} AS y FROM r a JOIN r b ON a.item_id = b.item_id AND a.idx < b.idx),
g AS (SELECT item_id, a, b, round(greatest(x, y), 6) AS weight FROM x WHERE x > 0.3 OR y > 0.2)"""
_ANCHORS = f"""j AS (SELECT qa.id, idx, round({_j(_KEY.format('question'), _KEY.format('paragraph_text'))}, 9) AS s, lower(trim(coalesce(predicted_answer, ''))) AS an, lower(coalesce(paragraph_text, '')) AS t FROM pa JOIN qa ON pa.item_id = qa.id),
an AS (SELECT id, arg_max(idx, (s, -idx)) AS question_idx, min(CASE WHEN an <> '' AND contains(t, an) THEN idx END) AS answer_idx FROM j GROUP BY id)"""
_SPANS = "sp AS (" + " UNION ALL ".join(
    f"SELECT item_id, idx, '{k}' AS kind, unnest(list_distinct(regexp_extract_all({_MASKED.format('paragraph_text')}, '{p}'))) AS span FROM pa"
    for k, p in (("quoted", '"[^"]{2,60}"'), ("year", PATTERNS["year"]), ("number", PATTERNS["number"]), ("name", PATTERNS["name"]))
) + ")"
_EDGES = f"WITH RECURSIVE {SQL_RELATIONS}, e AS (SELECT source_id AS src, target_id AS dst, max(weight) AS weight FROM rel GROUP BY ALL)"
_SEEDS = "seeds AS (SELECT DISTINCT src AS node FROM e WHERE try_cast(regexp_extract(src, '^note_[a-z]+_(\\d+)_', 1) AS INTEGER) % 50 = 0)"

SQL = {
    "passage_graph": f"{_W}, {_GRAPH} SELECT * FROM g",
    "passage_anchors": f"{_W}, {_ANCHORS} SELECT * FROM an",
    "hops_needed": f"""{_W}, {_GRAPH}, {_ANCHORS}, u AS (SELECT item_id AS id, a, b FROM g UNION SELECT item_id, b, a FROM g),
h1 AS (SELECT id, question_idx AS pos, answer_idx FROM an WHERE answer_idx IS NOT NULL), h2 AS (SELECT DISTINCT h1.id, u.b AS pos, answer_idx FROM h1 JOIN u ON h1.id = u.id AND h1.pos = u.a),
h3 AS (SELECT DISTINCT h2.id, u.b AS pos, answer_idx FROM h2 JOIN u ON h2.id = u.id AND h2.pos = u.a), h4 AS (SELECT DISTINCT h3.id, u.b AS pos, answer_idx FROM h3 JOIN u ON h3.id = u.id AND h3.pos = u.a),
n AS (SELECT id, min(n) AS n FROM (SELECT *, 1 AS n FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3 UNION ALL SELECT *, 4 FROM h4) WHERE pos = answer_idx GROUP BY id)
SELECT an.id, CASE WHEN answer_idx IS NULL THEN 2 ELSE greatest(2, coalesce(n, 4)) END::INTEGER AS k FROM an LEFT JOIN n USING (id)""",
    "passage_spans": f"{_W}, {_SPANS} SELECT * FROM sp",
    "best_span": f"""{_W}, {_SPANS}, w AS (SELECT id, {_MASKED.format('question')} AS q, CASE WHEN regexp_matches(lower(coalesce(question, '')), '^(when|in which year|what year)\\b') THEN 'year' WHEN regexp_matches(lower(coalesce(question, '')), '^how many\\b') THEN 'number'
  WHEN regexp_matches(lower(coalesce(question, '')), '^(who|where)\\b') THEN 'name' END AS kind FROM qa),
c AS (SELECT id, w.kind, span, count(*) AS n FROM w JOIN sp ON sp.item_id = w.id AND sp.kind = w.kind WHERE NOT contains(q, span) GROUP BY ALL)
SELECT id, span, kind FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, span) = 1""",
    "answer_features": f"""{_W} SELECT id, """
    + ", ".join(f"regexp_matches(lower(trim(coalesce(question, ''))), '\\b{w}\\b')::INT AS {w.replace(' ', '_')}" for w in ("who", "what", "when", "where", "why", "how many"))
    + f""", regexp_matches({_MASKED.format('predicted_answer')}, '[0-9]')::INT AS has_number, regexp_matches({_MASKED.format('predicted_answer')}, '{PATTERNS['year']}')::INT AS has_year, regexp_matches({_MASKED.format('predicted_answer')}, '{PATTERNS['name']}')::INT AS has_name,
  len(regexp_extract_all(lower(coalesce(predicted_answer, '')), '[\\p{{L}}\\p{{N}}_]+'))::INT AS n_words, round({_j(_ALL.format('question'), _ALL.format('predicted_answer'))}, 6) AS overlap FROM qa""",
    "answer_validation": f"""{_W}, n AS (SELECT DISTINCT id, lower(trim(coalesce(predicted_answer, ''))) AS a, unnest(predicted_support_idxs) AS idx FROM qa), j AS (SELECT n.id, a, n.idx, lower(coalesce(paragraph_text, '')) AS t FROM n LEFT JOIN pa ON pa.item_id = n.id AND pa.idx = n.idx WHERE n.idx IS NOT NULL)
SELECT id, count(*) AS n_named, count(*) FILTER (WHERE a <> '' AND contains(t, a)) AS n_holding, count(*) FILTER (WHERE a <> '' AND contains(t, a)) > 0 AS valid FROM j GROUP BY id""",
    "weighted_neighbourhood": f"""{_EDGES}, {_SEEDS}, h0 AS (SELECT node, 0.0::DOUBLE AS distance FROM seeds),
h1 AS (SELECT node, min(distance) AS distance FROM (SELECT * FROM h0 UNION ALL SELECT dst, round(distance + 1 - weight, 6) FROM h0 JOIN e ON node = src) GROUP BY node),
h2 AS (SELECT node, min(distance) AS distance FROM (SELECT * FROM h1 UNION ALL SELECT dst, round(distance + 1 - weight, 6) FROM h1 JOIN e ON node = src) GROUP BY node)
SELECT node, min(distance) AS distance FROM (SELECT * FROM h2 UNION ALL SELECT dst, round(distance + 1 - weight, 6) FROM h2 JOIN e ON node = src) GROUP BY node""",
}
