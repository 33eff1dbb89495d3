"""Scores of candidates for a query: required terms, noise rules, boosts, fusion of several retrievals, hop-wise reranking,
scheduling. All of it is column arithmetic over one frame of candidates with windows per query.

A frame of candidates has query, candidate, title, content, blob (title and content in lower case), dense, sparse, must
(terms that should occur), stems (predicates asked for), path (entities asked for), focus (text), names and hop_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import sqlkit as sk
from noteflow.functions import text as tx
from noteflow.operators.evaluation import items, passages
from noteflow.operators.extraction import masked
from noteflow.operators.lexical import FOCUS_STOPS, focus_phrase

RUN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
# Stems of predicates that a question may ask for, and words that lower a candidate.
STEMS = "founded located member work part instance born died created".split()
LOWERING = ["found", "co founded", "founded"]
#: Weights of the two scores, the constant of rank fusion, and the least score of a candidate without a required term.
DENSE, SPARSE, RANK_K, NOISE = 1.0, 0.6, 50, 0.20
BEST = "query"


def candidates(q: DataFrame, p: DataFrame) -> DataFrame:
    """The passages of each question as candidates. dense and sparse are the word overlaps with and without stop words (where
    an index supplies better scores, they replace these columns); hop_no is 1 if a required term occurs, else 2."""
    asked = q.select(
        F.col("id").alias("query"), F.coalesce("question", F.lit("")).alias("question"),
        F.transform(F.array_distinct(F.regexp_extract_all(masked(F.col("question")), F.lit(RUN), F.lit(0))), lambda x: F.lower(x)).alias("path"),
        F.filter(F.array(*[F.lit(s) for s in STEMS]), lambda s: F.contains(F.lower(F.coalesce("question", F.lit(""))), s)).alias("stems"), focus_phrase(F.col("question")).alias("phrase"),
    ).withColumn("must", F.array_distinct(F.concat("path", "stems")))
    own = p.select(
        F.col("item_id").alias("query"), F.col("idx").alias("candidate"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("paragraph_text", F.lit("")).alias("content"), "is_supporting",
        F.transform(F.array_distinct(F.regexp_extract_all(masked(F.col("paragraph_text")), F.lit(RUN), F.lit(0))), lambda x: F.lower(x)).alias("names"),
    ).withColumn("blob", F.lower(F.concat_ws(" ", "title", "content")))
    c = own.join(asked, "query")
    words = lambda t, stop=None: tx.word_set(F.col(t), stop)
    focus = F.trim(F.concat_ws(" ", F.array_join(F.slice("path", F.greatest(F.lit(1), F.size("path") - 1), 2), " "), "phrase"))
    return (
        c.withColumn("dense", tx.rounded(tx.jaccard(words("question"), words("content")), 6))
        .withColumn("sparse", tx.rounded(tx.jaccard(words("question", tx.STOP_WORDS), words("content", tx.STOP_WORDS)), 6))
        .withColumn("focus", focus).withColumn("hits", F.size(F.filter("must", lambda t: F.contains(F.col("blob"), t))))
        .withColumn("hop_no", F.when(F.col("hits") > 0, 1).otherwise(2))
    )


def has_term() -> Column:
    """True if a required term occurs in title or content; true if none is required."""
    return (F.size("must") == 0) | (F.col("hits") > 0)


def lexical_factor() -> Column:
    """0.6 without any required term, 0.8 with fewer than half of them, else 1."""
    return F.when(F.size("must") == 0, 1.0).when(F.col("hits") == 0, 0.6).when(F.col("hits") * 2 < F.size("must"), 0.8).otherwise(1.0)


def section_factor(role: Column) -> Column:
    """0.8 for a section that is neither main nor primary; 1 where no role is known."""
    return F.when(role.isNull() | F.lower(role).rlike("main|primary"), 1.0).otherwise(0.8)


def hit_power(terms: str, base: float, most: float, text: str = "content") -> Column:
    """`base` for each of the terms that the text holds, multiplied, at most `most`."""
    return F.least(F.pow(F.lit(base), F.size(F.filter(terms, lambda t: F.contains(F.lower(F.col(text)), t)))), F.lit(most))


def predicate_penalty() -> Column:
    """0.7 for a candidate that tells of a founding."""
    return F.when(F.col("blob").rlike("|".join(LOWERING)), 0.7).otherwise(1.0)


def hybrid(c: DataFrame) -> DataFrame:
    """query, candidate, base, place: dense + 0.6 sparse, times the factors of section and required terms, 0 under NOISE
    without a required term, times 1.2 per entity (2 at most) and 1.15 per predicate (1.8 at most); zeros drop out."""
    role = F.when(F.col("title") != "", F.when(F.contains(F.lower("question"), F.lower("title")), "main").otherwise("other"))
    base = (DENSE * F.col("dense") + SPARSE * F.col("sparse")) * section_factor(role) * lexical_factor()
    base = F.when((base < NOISE) & ~has_term(), 0.0).otherwise(base)
    base = base * F.when(F.size("path") > 0, hit_power("path", 1.2, 2.0)).otherwise(1.0) * F.when(F.size("stems") > 0, hit_power("stems", 1.15, 1.8)).otherwise(1.0)
    out = c.withColumn("base", F.round(base, 6)).where("base > 0")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(BEST).orderBy(F.desc("base"), "candidate")))


def linear_hybrid(c: DataFrame, dense: float = 0.7, sparse: float = 0.3) -> DataFrame:
    """query, candidate, score: weighted sum; without a required term in the content the sparse score counts a tenth, each
    entity in it raises the dense one by 1.2, each predicate the sparse one by 1.3."""
    low = F.lower("content")
    none = (F.size("must") > 0) & ~F.exists("must", lambda t: F.contains(low, t))
    d = F.col("dense") * hit_power("path", 1.2, 1e9)
    s = F.col("sparse") * F.when(none, 0.1).otherwise(1.0) * hit_power("stems", 1.3, 1e9)
    return c.select("query", "candidate", F.round(dense * d + sparse * s, 6).alias("score"))


def rank_hybrid(c: DataFrame, dense: float = 0.7, sparse: float = 0.3, k: int = 60) -> DataFrame:
    """query, candidate, score: dense / (k + rank) + sparse / (k + rank), ranks from 0, ties by candidate; a tenth without a
    required term in the content."""
    w = Window.partitionBy("query")
    none = (F.size("must") > 0) & ~F.exists("must", lambda t: F.contains(F.lower("content"), t))
    ranked = c.withColumn("rd", F.row_number().over(w.orderBy(F.desc("dense"), "candidate")) - 1).withColumn("rs", F.row_number().over(w.orderBy(F.desc("sparse"), "candidate")) - 1)
    score = (dense / (k + F.col("rd")) + sparse / (k + F.col("rs"))) * F.when(none, 0.1).otherwise(1.0)
    return ranked.select("query", "candidate", F.round(score, 9).alias("score"))


def khop_scores(c: DataFrame) -> DataFrame:
    """The candidates with cov (share of the asked entities among their names), cons (1 if one is in the text), focused
    (overlap with the focus), rrf and final = (dense + 0.6 sparse + weight focused + 0.10 cov + 0.05 cons + 0.2 rrf) *
    0.85 ** (hop - 1), weight 0.30 at hop 2, else 0.30 - 0.10 (hop - 2), not under 0."""
    w = Window.partitionBy("query")
    rank = lambda s: 1 / (RANK_K + F.row_number().over(w.orderBy(F.desc(s), "candidate")))
    cov = F.when(F.size("path") > 0, F.size(F.array_intersect("names", "path")) / F.size("path")).otherwise(0.0)
    cons = F.exists("path", lambda e: F.contains(F.col("blob"), e)).cast("int")
    focused = F.when(F.col("focus") != "", tx.jaccard(tx.word_set(F.col("focus")), tx.word_set(F.col("content")))).otherwise(0.0)
    c = c.withColumn("cov", F.round(cov, 6)).withColumn("cons", cons).withColumn("focused", F.round(focused, 6)).withColumn("rrf", F.round(rank("dense") + rank("sparse"), 9))
    weight = F.when(F.col("hop_no") == 2, 0.30).otherwise(F.greatest(F.lit(0.0), 0.30 - 0.10 * (F.col("hop_no") - 2)))
    final = DENSE * F.col("dense") + SPARSE * F.col("sparse") + weight * F.col("focused") + 0.10 * F.col("cov") + 0.05 * F.col("cons") + 0.2 * F.col("rrf")
    return c.withColumn("final", F.round(final * F.pow(F.lit(0.85), F.col("hop_no") - 1), 6))


def passes_noise_rules() -> Column:
    """A final score of NOISE or more, and a required term if any is required."""
    return (F.col("final") >= NOISE) & has_term()


def noise_filtered(c: DataFrame, keep: int = 5, tail: float = 0.10) -> DataFrame:
    """First-hop candidates that pass the noise rules; of the second hop the best `keep` whatever they score, the rest from
    `tail` on with a required term."""
    w = Window.partitionBy("query", "hop_no").orderBy(F.desc("final"), "candidate")
    c = c.withColumn("n", F.row_number().over(w))
    return c.where(F.when(F.col("hop_no") == 2, (F.col("n") <= keep) | ((F.col("final") >= tail) & has_term())).otherwise(passes_noise_rules())).drop("n")


def multihop_safety(c: DataFrame, keep: int = 6, tail: float = 0.10, first_doc: str | None = None) -> DataFrame:
    """Of each hop the best `keep`, the rest from `tail` on if an asked entity occurs (or none is asked); and if no candidate
    of the first hop's document is left, the best of that document. Documents are told by their titles; the first hop's is
    `first_doc`, or that of its best candidate."""
    w = Window.partitionBy("query", "hop_no").orderBy(F.desc("final"), "candidate")
    occurs = (F.size("path") == 0) | F.exists("path", lambda e: F.contains(F.col("blob"), e))
    one = Window.partitionBy("query")
    c = c.withColumn("n", F.row_number().over(w)).withColumn("kept", (F.col("n") <= keep) | ((F.col("final") >= tail) & occurs))
    c = c.withColumn("doc", F.lit(first_doc) if first_doc is not None else F.max(F.when((F.col("hop_no") == 1) & (F.col("n") == 1), F.col("title"))).over(one))
    own = Window.partitionBy("query", "title").orderBy(F.desc("final"), "candidate")
    saved = (F.col("title") == F.col("doc")) & (F.row_number().over(own) == 1) & ~F.max(F.col("kept")).over(Window.partitionBy("query", "title"))
    return c.withColumn("saved", F.coalesce(saved, F.lit(False))).where("kept OR saved").drop("n", "doc")


def path_reranked(c: DataFrame) -> DataFrame:
    """query, candidate, connected, path_score, final: a candidate whose names meet those of both hops gets 0.5 times its
    quality (0.7 dense + 0.3 names / 5, each at most 1), and 0.3 of that is added to its base score."""
    w = Window.partitionBy("query")
    names = lambda hop: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("hop_no") == hop, F.col("names"))).over(w)))
    connected = F.arrays_overlap("names", names(1)) & F.arrays_overlap("names", names(2))
    quality = F.least(0.7 * F.col("dense") + 0.3 * F.least(F.size("names") / 5, F.lit(1.0)), F.lit(1.0))
    c = c.withColumn("connected", F.coalesce(connected, F.lit(False))).withColumn("path_score", tx.rounded(F.when(F.col("connected"), 0.5 * quality).otherwise(0.0), 6))
    base = DENSE * F.col("dense") + SPARSE * F.col("sparse")
    return c.select("query", "candidate", "connected", "path_score", tx.rounded(base + 0.3 * F.col("path_score"), 6).alias("final"))


# Weights and words of the rules for records of music.
ALBUM, SONG, SUPPORTING, ASKED = 0.5, -0.3, 0.4, 0.3
ALBUM_SIGNS, SONG_SIGNS, PERFORMER_WORDS, ALBUM_WORDS = r"\(album\)| album", r"\(song\)| single|\(film\)", "performer|singer|vocalist", "album|record|ep"


def evidence_reranked(c: DataFrame) -> DataFrame:
    """query, candidate, score, place: the final score plus the weights of the rules that hold; ties by candidate."""
    text, asked = F.lower(F.concat_ws(" \n", "title", "content")), F.lower("question")
    album = text.rlike(ALBUM_SIGNS)
    score = F.col("final") + ALBUM * album.cast("int") + SONG * text.rlike(SONG_SIGNS).cast("int") + SUPPORTING * F.coalesce("is_supporting", F.lit(False)).cast("int")
    score = score + ASKED * (album & asked.rlike(PERFORMER_WORDS) & asked.rlike(ALBUM_WORDS)).cast("int")
    c = c.select("query", "candidate", F.round(score, 6).alias("score"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate")))


# Weights of the four retrievals.
FUSION = {"dense": 1.0, "bm25": 0.5, "graph": 0.35, "path": 0.3}


def sources(c: DataFrame) -> DataFrame:
    """query, candidate, source, value: the scores of four retrievals in long form; absent ones give no row."""
    graph = F.when(F.size(F.array_intersect("names", "path")) > 0, F.size(F.array_intersect("names", "path")).cast("double"))
    parts = {"dense": F.when(F.col("dense") > 0, F.col("dense")), "bm25": F.when(F.col("sparse") > 0, F.col("sparse")), "graph": graph, "path": F.when(F.col("cons") == 1, F.col("cov"))}
    rows = F.array(*[F.struct(F.lit(k).alias("source"), v.alias("value")) for k, v in parts.items()])
    return c.select("query", "candidate", F.explode(rows).alias("x")).select("query", "candidate", "x.source", "x.value").where("value IS NOT NULL")


def fuse_linear(s: DataFrame, pool: int = 80) -> DataFrame:
    """query, candidate, score, place: each source but path divided by the query's largest of it, weighted, added."""
    top = F.max("value").over(Window.partitionBy("query", "source"))
    weight = F.create_map(*[F.lit(x) for kv in FUSION.items() for x in kv])[F.col("source")]
    value = F.when(F.col("source") == "path", F.col("value")).when(top == 0, 0.0).otherwise(F.col("value") / top)
    one = s.withColumn("v", value * weight).groupBy("query", "candidate").agg(F.round(F.sum("v"), 6).alias("score"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))).where(F.col("place") <= pool)


def fuse_ranks(s: DataFrame, k: int = 60, pool: int = 80) -> DataFrame:
    """query, candidate, score, place: weight / (k + rank) of each source but path, plus the weighted path score; candidates
    that only path has drop out."""
    rank = F.row_number().over(Window.partitionBy("query", "source").orderBy(F.desc("value"), "candidate"))
    weight = F.create_map(*[F.lit(x) for kv in FUSION.items() for x in kv])[F.col("source")]
    own = s.withColumn("v", F.when(F.col("source") == "path", F.col("value") * weight).otherwise(weight / (k + rank)))
    one = own.groupBy("query", "candidate").agg(F.round(F.sum("v"), 9).alias("score"), F.max(F.col("source") != "path").alias("ranked")).where("ranked").drop("ranked")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))).where(F.col("place") <= pool)


def scheduled(c: DataFrame, top: int = 10) -> DataFrame:
    """query, candidate, score, place: 0.3 dense + 0.25 cov + 0.2 if the passage has a title (its topic) + 0.15 if it is known
    to support; equal contents of a query once (the first), the best `top`, or three if that is fewer."""
    w = Window.partitionBy("query", "content").orderBy("candidate")
    one = c.withColumn("n", F.row_number().over(w)).where("n = 1")
    score = 0.3 * F.col("dense") + 0.25 * F.col("cov") + 0.2 * (F.col("title") != "").cast("int") + 0.15 * F.coalesce("is_supporting", F.lit(False)).cast("int")
    one = one.select("query", "candidate", F.round(score, 6).alias("score"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))).where(F.col("place") <= max(top, 3))


def dispatched(s: DataFrame, semantic: int = 8, graph: int = 5, bridge_boost: float = 0.02) -> DataFrame:
    """query, candidate, score, is_bridge, place: the best `semantic` of the dense source and the best `graph` of the graph
    source together; what path also knows is a bridge and scores a little more."""
    n = F.row_number().over(Window.partitionBy("query", "source").orderBy(F.desc("value"), "candidate"))
    limit = F.when(F.col("source") == "dense", semantic).when(F.col("source") == "graph", graph)
    taken = s.where(F.col("source").isin("dense", "graph")).withColumn("n", n).where(F.col("n") <= limit)
    bridges = s.where("source = 'path'").select("query", "candidate", F.lit(True).alias("is_bridge"))
    one = taken.groupBy("query", "candidate").agg(F.max("value").alias("v")).join(bridges, ["query", "candidate"], "left").fillna(False, ["is_bridge"])
    one = one.select("query", "candidate", F.round(F.col("v") + bridge_boost * F.col("is_bridge").cast("int"), 6).alias("score"), "is_bridge")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate")))


def evidence_types(c: DataFrame) -> DataFrame:
    """query, candidate, density, types: kinds of evidence - path_aware (coverage over 0.3), entity_rich (over 0.5 names a
    word), semantic (final over 0.7), graph (an asked entity occurs), general if none."""
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    density = F.when(words > 0, F.size("names") / words).otherwise(0.0)
    kinds = F.array_compact(F.array(F.when(F.col("cons") == 1, "graph"), F.when(F.col("cov") > 0.3, "path_aware"), F.when(density > 0.5, "entity_rich"), F.when(F.col("final") > 0.7, "semantic")))
    return c.select("query", "candidate", F.round(density, 6).alias("density"), F.array_join(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("general"))), ",").alias("types"))


def mean_diversity(c: DataFrame) -> DataFrame:
    """query, n, diversity: one minus the mean word overlap of the pairs of a query's candidates; 1 for fewer than two."""
    sets = F.collect_list(tx.word_set(F.col("content")))
    g = c.groupBy("query").agg(sets.alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: tx.jaccard(a, b))))
    total = F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y)
    return g.select("query", F.size("s").alias("n"), F.round(F.when(F.size("s") < 2, 1.0).otherwise(1 - total / F.size(pairs)), 5).alias("diversity"))


def coverage_guard(c: DataFrame) -> DataFrame:
    """query, candidate, place: candidates grouped by the part of the question (hop) they answer, each group led by its best."""
    w = Window.partitionBy("query", "hop_no").orderBy(F.desc("dense"), "candidate")
    c = c.withColumn("lead", F.row_number().over(w) == 1)
    return c.select("query", "candidate", F.row_number().over(Window.partitionBy("query").orderBy("hop_no", F.desc("lead"), "candidate")).alias("place"))


def _c(make, *, scored: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        c = candidates(items(s, d), passages(s, d))
        return make(khop_scores(c) if scored else c)

    return run


_KEYS = ["query", "candidate"]
QUERIES = {
    "candidate_terms": _c(lambda c: c.select(*_KEYS, F.size("must").alias("n_must"), "hits", has_term().alias("satisfies"), lexical_factor().alias("lexical"), predicate_penalty().alias("penalty"))),
    "candidate_boosts": _c(lambda c: c.select(*_KEYS, F.round(hit_power("path", 1.2, 2.0), 6).alias("entity_boost"), F.round(hit_power("stems", 1.15, 1.8), 6).alias("predicate_boost"))),
    "hybrid_search": _c(lambda c: hybrid(c).select(*_KEYS, "base", "place")),
    "hybrid_linear": _c(linear_hybrid),
    "hybrid_ranks": _c(rank_hybrid),
    "khop_reranked": _c(lambda c: c.select(*_KEYS, "hop_no", "cov", "cons", "focused", "final"), scored=True),
    "noise_rules": _c(lambda c: c.where(passes_noise_rules()).select(*_KEYS), scored=True),
    "noise_filtered": _c(lambda c: noise_filtered(c).select(*_KEYS), scored=True),
    "multihop_safety": _c(lambda c: multihop_safety(c).select(*_KEYS, "saved"), scored=True),
    "path_reranked": _c(path_reranked),
    "evidence_reranked": _c(evidence_reranked, scored=True),
    "sources_fused": _c(lambda c: fuse_linear(sources(c)), scored=True),
    "sources_rank_fused": _c(lambda c: fuse_ranks(sources(c)), scored=True),
    "context_scheduled": _c(scheduled, scored=True),
    "context_dispatched": _c(lambda c: dispatched(sources(c)), scored=True),
    "evidence_types": _c(evidence_types, scored=True),
    "candidate_diversity": _c(mean_diversity),
    "coverage_guard": _c(coverage_guard),
}


_W = f"WITH {sk.QA}, {sk.PASSAGES}"
_STOP = [*tx.STOP_WORDS]
_CAND = f"""aq AS (SELECT id AS query, coalesce(question, '') AS question, list_transform(regexp_extract_all({sk.MASKED.format('question')}, '{RUN}'), lambda x: lower(x)) AS p0, regexp_extract_all({sk.MASKED.format('question')}, '{RUN}') AS runs,
  list_filter({sk.quoted(STEMS)}, lambda s: contains(lower(coalesce(question, '')), s)) AS stems, {sk.WORDS.format('question')} AS qw,
  array_to_string(list_filter(regexp_extract_all(lower(regexp_replace({sk.MASKED.format('question')}, '{RUN}', ' ', 'g')), '[a-z]+'), lambda w: length(w) >= 2 AND NOT list_contains({sk.quoted(FOCUS_STOPS)}, w))[1:4], ' ') AS phrase FROM qa),
aq1 AS (SELECT *, list_transform(list_filter(runs, lambda x, i: list_position(runs, x) = i), lambda x: lower(x)) AS path FROM aq), aq2 AS (SELECT *, list_concat(path, stems) AS m0 FROM aq1), aq3 AS (SELECT *, list_filter(m0, lambda x, i: list_position(m0, x) = i) AS must FROM aq2),
ap AS (SELECT item_id AS query, idx AS candidate, coalesce(title, '') AS title, coalesce(paragraph_text, '') AS content, is_supporting, lower(coalesce(title, '') || ' ' || coalesce(paragraph_text, '')) AS blob,
  list_transform(list_distinct(regexp_extract_all({sk.MASKED.format('paragraph_text')}, '{RUN}')), lambda x: lower(x)) AS names, {sk.WORDS.format('paragraph_text')} AS pw FROM pa),
c0 AS (SELECT ap.*, aq3.question, aq3.path, aq3.stems, aq3.must, qw, trim(concat_ws(' ', array_to_string(path[-2:], ' '), phrase)) AS focus, len(list_filter(must, lambda t: contains(blob, t)))::INTEGER AS hits FROM ap JOIN aq3 USING (query)),
c AS (SELECT *, round({sk.jaccard('qw', 'pw')}, 6) AS dense, round({sk.jaccard(sk.without('qw', _STOP), sk.without('pw', _STOP))}, 6) AS sparse, CASE WHEN hits > 0 THEN 1 ELSE 2 END AS hop_no,
  (len(must) = 0 OR hits > 0) AS has_term, CASE WHEN len(must) = 0 THEN 1.0 WHEN hits = 0 THEN 0.6 WHEN hits * 2 < len(must) THEN 0.8 ELSE 1.0 END::DOUBLE AS lexical FROM c0)"""
_FOCUS = "list_filter(list_distinct(regexp_split_to_array(lower(focus), '\\s+')), lambda w: w <> '')"
_SCORED = f"""k0 AS (SELECT *, round(CASE WHEN len(path) > 0 THEN len(list_intersect(names, path)) / len(path)::DOUBLE ELSE 0.0 END, 6) AS cov, (len(list_filter(path, lambda e: contains(blob, e))) > 0)::INT AS cons,
  round(CASE WHEN focus <> '' THEN {sk.jaccard(_FOCUS, 'pw')} ELSE 0.0 END, 6) AS focused, round(1 / (50 + row_number() OVER (PARTITION BY query ORDER BY dense DESC, candidate))::DOUBLE + 1 / (50 + row_number() OVER (PARTITION BY query ORDER BY sparse DESC, candidate))::DOUBLE, 9) AS rrf FROM c),
k AS (SELECT *, round((dense + 0.6::DOUBLE * sparse + CASE WHEN hop_no = 2 THEN 0.30::DOUBLE ELSE greatest(0.0::DOUBLE, 0.30::DOUBLE - 0.10::DOUBLE * (hop_no - 2)) END * focused + 0.10::DOUBLE * cov + 0.05::DOUBLE * cons + 0.2::DOUBLE * rrf) * pow(0.85::DOUBLE, hop_no - 1), 6) AS final FROM k0)"""
_B, _K = f"{_W}, {_CAND}", f"{_W}, {_CAND}, {_SCORED}"
_HITS = lambda terms, base, most: f"least(pow({base}::DOUBLE, len(list_filter({terms}, lambda t: contains(lower(content), t)))), {most}::DOUBLE)"
_NONE = "len(must) > 0 AND len(list_filter(must, lambda t: contains(lower(content), t))) = 0"
_TOP = "row_number() OVER (PARTITION BY query ORDER BY {0} DESC, candidate)::INTEGER"
_SOURCES = """so AS (SELECT query, candidate, 'dense' AS source, dense AS value FROM k WHERE dense > 0 UNION ALL SELECT query, candidate, 'bm25', sparse FROM k WHERE sparse > 0
  UNION ALL SELECT query, candidate, 'graph', len(list_intersect(names, path))::DOUBLE FROM k WHERE len(list_intersect(names, path)) > 0 UNION ALL SELECT query, candidate, 'path', cov FROM k WHERE cons = 1)"""
_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FUSION.items()) + " END::DOUBLE"

SQL = {
    "candidate_terms": f"{_B} SELECT query, candidate, len(must)::INTEGER AS n_must, hits, has_term AS satisfies, lexical, CASE WHEN regexp_matches(blob, 'found') THEN 0.7 ELSE 1.0 END::DOUBLE AS penalty FROM c",
    "candidate_boosts": f"{_B} SELECT query, candidate, round({_HITS('path', 1.2, 2.0)}, 6) AS entity_boost, round({_HITS('stems', 1.15, 1.8)}, 6) AS predicate_boost FROM c",
    "hybrid_search": f"""{_B}, b AS (SELECT *, (dense + 0.6::DOUBLE * sparse) * CASE WHEN title = '' OR contains(lower(question), lower(title)) THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END * lexical AS b FROM c),
r AS (SELECT query, candidate, round(CASE WHEN b < 0.20 AND NOT has_term THEN 0.0 ELSE b END * {_HITS('path', 1.2, 2.0)} * {_HITS('stems', 1.15, 1.8)}, 6) AS base FROM b) SELECT *, {_TOP.format('base')} AS place FROM r WHERE base > 0""",
    "hybrid_linear": f"{_B} SELECT query, candidate, round(0.7::DOUBLE * (dense * {_HITS('path', 1.2, 1e9)}) + 0.3::DOUBLE * (sparse * CASE WHEN {_NONE} THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END * {_HITS('stems', 1.3, 1e9)}), 6) AS score FROM c",
    "hybrid_ranks": f"""{_B}, r AS (SELECT *, {_TOP.format('dense')} - 1 AS rd, {_TOP.format('sparse')} - 1 AS rs FROM c)
SELECT query, candidate, round((0.7::DOUBLE / (60 + rd) + 0.3::DOUBLE / (60 + rs)) * CASE WHEN {_NONE} THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM r""",
    "khop_reranked": f"{_K} SELECT query, candidate, hop_no, cov, cons, focused, final FROM k",
    "noise_rules": f"{_K} SELECT query, candidate FROM k WHERE final >= 0.20 AND has_term",
    "noise_filtered": f"{_K}, n AS (SELECT *, row_number() OVER (PARTITION BY query, hop_no ORDER BY final DESC, candidate) AS n FROM k) SELECT query, candidate FROM n WHERE (hop_no = 1 AND final >= 0.20 AND has_term) OR (hop_no = 2 AND (n <= 5 OR (final >= 0.10 AND has_term)))",
    "multihop_safety": f"""{_K}, n AS (SELECT *, row_number() OVER (PARTITION BY query, hop_no ORDER BY final DESC, candidate) AS n FROM k), f AS (SELECT *, n <= 6 OR (final >= 0.10 AND (len(path) = 0 OR cons = 1)) AS kept FROM n),
d AS (SELECT query, title AS doc FROM n WHERE hop_no = 1 AND n = 1), lost AS (SELECT query, doc FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query = d.query AND f.title = d.doc AND kept)),
s AS (SELECT f.query, arg_max(candidate, (final, -candidate)) AS candidate FROM f JOIN lost ON f.query = lost.query AND f.title = lost.doc GROUP BY f.query)
SELECT query, candidate, false AS saved FROM f WHERE kept UNION ALL SELECT query, candidate, true FROM s""",
    "path_reranked": f"""{_B}, h AS (SELECT query, list_distinct(flatten(list(CASE WHEN hop_no = 1 THEN names END))) AS n1, list_distinct(flatten(list(CASE WHEN hop_no = 2 THEN names END))) AS n2 FROM c GROUP BY query),
j AS (SELECT c.*, coalesce(list_has_any(names, n1) AND list_has_any(names, n2), false) AS connected FROM c JOIN h USING (query)),
s AS (SELECT *, round(CASE WHEN connected THEN 0.5::DOUBLE * least(0.7::DOUBLE * dense + 0.3::DOUBLE * least(len(names) / 5.0::DOUBLE, 1.0), 1.0) ELSE 0.0 END, 6) AS path_score FROM j)
SELECT query, candidate, connected, path_score, round(dense + 0.6::DOUBLE * sparse + 0.3::DOUBLE * path_score, 6) AS final FROM s""",
    "evidence_reranked": f"""{_K}, t AS (SELECT *, lower(title || ' ' || chr(10) || content) AS t, lower(question) AS q FROM k), s AS (SELECT query, candidate, round(final + 0.5::DOUBLE * regexp_matches(t, '\\(album\\)| album')::INT - 0.3::DOUBLE * regexp_matches(t, '\\(song\\)| single|\\(film\\)')::INT
  + 0.4::DOUBLE * coalesce(is_supporting, false)::INT + 0.3::DOUBLE * (regexp_matches(t, '\\(album\\)| album') AND regexp_matches(q, '{PERFORMER_WORDS}') AND regexp_matches(q, '{ALBUM_WORDS}'))::INT, 6) AS score FROM t) SELECT *, {_TOP.format('score')} AS place FROM s""",
    "sources_fused": f"""{_K}, {_SOURCES}, m AS (SELECT *, max(value) OVER (PARTITION BY query, source) AS top FROM so), o AS (SELECT query, candidate, round(sum(CASE WHEN source = 'path' THEN value WHEN top = 0 THEN 0.0 ELSE value / top END * {_WEIGHT}), 6) AS score FROM m GROUP BY ALL)
SELECT *, {_TOP.format('score')} AS place FROM o QUALIFY place <= 80""",
    "sources_rank_fused": f"""{_K}, {_SOURCES}, m AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY value DESC, candidate) AS rank FROM so),
o AS (SELECT query, candidate, round(sum(CASE WHEN source = 'path' THEN value * {_WEIGHT} ELSE {_WEIGHT} / (60 + rank) END), 9) AS score FROM m GROUP BY ALL HAVING bool_or(source <> 'path')) SELECT *, {_TOP.format('score')} AS place FROM o QUALIFY place <= 80""",
    "context_scheduled": f"""{_K}, o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query, content ORDER BY candidate) = 1), s AS (SELECT query, candidate, round(0.3::DOUBLE * dense + 0.25::DOUBLE * cov + 0.2::DOUBLE * (title <> '')::INT + 0.15::DOUBLE * coalesce(is_supporting, false)::INT, 6) AS score FROM o)
SELECT *, {_TOP.format('score')} AS place FROM s QUALIFY place <= 10""",
    "context_dispatched": f"""{_K}, {_SOURCES}, t AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY value DESC, candidate) AS n FROM so WHERE source IN ('dense', 'graph') QUALIFY n <= CASE source WHEN 'dense' THEN 8 ELSE 5 END),
o AS (SELECT t.query, t.candidate, max(t.value) AS v, bool_or(b.source IS NOT NULL) AS is_bridge FROM t LEFT JOIN so b ON b.query = t.query AND b.candidate = t.candidate AND b.source = 'path' GROUP BY ALL), s AS (SELECT query, candidate, round(v + 0.02::DOUBLE * is_bridge::INT, 6) AS score, is_bridge FROM o)
SELECT *, {_TOP.format('score')} AS place FROM s""",
    "evidence_types": f"""{_K}, d AS (SELECT *, len({sk.SPLIT.format('content')}) AS w FROM k), e AS (SELECT *, CASE WHEN w > 0 THEN len(names) / w::DOUBLE ELSE 0.0 END AS density FROM d)
SELECT query, candidate, round(density, 6) AS density, coalesce(nullif(concat_ws(',', CASE WHEN cons = 1 THEN 'graph' END, CASE WHEN cov > 0.3 THEN 'path_aware' END, CASE WHEN density > 0.5 THEN 'entity_rich' END, CASE WHEN final > 0.7 THEN 'semantic' END), ''), 'general') AS types FROM e""",
    "candidate_diversity": f"""{_B}, p AS (SELECT a.query, avg({sk.jaccard('a.pw', 'b.pw')}) AS m FROM c a JOIN c b ON a.query = b.query AND a.candidate < b.candidate GROUP BY a.query), n AS (SELECT query, count(*)::INTEGER AS n FROM c GROUP BY query)
SELECT query, n, round(CASE WHEN n < 2 THEN 1.0 ELSE 1 - m END, 5) AS diversity FROM n LEFT JOIN p USING (query)""",
    "coverage_guard": f"""{_B}, l AS (SELECT *, row_number() OVER (PARTITION BY query, hop_no ORDER BY dense DESC, candidate) = 1 AS lead FROM c) SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY hop_no, lead DESC, candidate)::INTEGER AS place FROM l""",
}
