"""Answers against their evidence: entailment features, corrections, spans, sentence coverage, passages needed, support.

The evidence of an item is the texts of its passages in the order of idx; what is chosen among passages, sentences or
spans is chosen by windows per item, ties by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import sqlkit as sk
from noteflow.functions import text as tx
from noteflow.functions.runtime import stage
from noteflow.operators.evaluation import items, passages
from noteflow.operators.extraction import masked

# Stop words of answers and questions, signs of places, deeds and kinship.
STOPS = "the a an and or but in on at to for of with by".split()
QUESTION_STOPS = [*STOPS, "is", "are", "was", "were"]
PLACES, DEEDS, KIN = "in at from to city country".split(), "performed sang played acted directed".split(), "married spouse husband wife partner".split()
MULTI_HOP = [
    "who performed", "who sang", "who directed", "who wrote", "what album", "what movie", "what song", "when was", "where was", "spouse of", "husband of", "wife of", "and", "also", "both",
]
ASKING = "who what when where why how".split()
NO_ENTITIES = "the and or but in on at to for of with".split()
RUN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
TEMPORAL, DATE = r"\b[0-9]{4}\b|\b[0-9]{1,2}/[0-9]{1,2}|\bin\s+[0-9]{4}|\bon\s+\w+", r"\b[0-9]{4}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"


def flag(c: Column) -> Column:
    return c.cast("int")


def any_of(low: Column, words: list[str]) -> Column:
    """True if the text holds any of the words as a part."""
    return low.rlike("|".join(words))


def words_of(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def overlap(a: Column, b: Column, stop: list[str]) -> Column:
    """Jaccard of word sets without stop words; 0 if either is empty."""
    return tx.jaccard(tx.word_set(a, stop), tx.word_set(b, stop))


def evidence(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, question, answer, sentences (texts of the passages), text (all of them), low (in lower case)."""
    own = p.where(F.coalesce("paragraph_text", F.lit("")) != "").groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "paragraph_text"))).alias("x"))
    s = F.coalesce(F.transform("x", lambda x: x["paragraph_text"]), F.array().cast("array<string>"))
    j = q.select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("predicted_answer", F.lit("")).alias("answer")).join(own, "id", "left")
    return j.select("id", "question", "answer", s.alias("sentences")).withColumn("text", F.array_join("sentences", " ")).withColumn("low", F.lower("text"))


def answer_share(a: Column, text: Column) -> Column:
    """The share of the answer's words among the words of the evidence."""
    w = tx.word_set(a)
    return F.when((F.size(w) > 0) & (text != ""), F.size(F.array_intersect(w, tx.word_set(text))) / F.size(w)).otherwise(0.0)


def entailment_features(e: DataFrame) -> DataFrame:
    """id and the features of an answer: its words (20 at most), likeness to the question, share of its words in the evidence,
    verbatim there, four flags of the kind asked for, three of the evidence, four of its form."""
    q, a, low = F.lower("question"), F.col("answer"), F.lower("answer")
    m = masked(F.col("answer"))
    count = F.size("sentences")
    lengths = F.aggregate(F.transform("sentences", lambda s: F.size(words_of(s))), F.lit(0), lambda x, y: x + y)
    w = tx.word_set(a)
    covered = F.size(F.filter(w, lambda x: F.contains(F.col("low"), x)))
    some = lambda v: F.when(count > 0, v).otherwise(0.0)
    return e.select(
        "id", F.least(F.size(words_of(a)), F.lit(20)).alias("n_words"), F.round(overlap(F.col("question"), a, STOPS), 6).alias("question_likeness"), F.round(answer_share(a, F.col("text")), 6).alias("evidence_share"),
        flag(F.contains(F.col("low"), low)).alias("verbatim"),
        flag(any_of(q, ["who", "whom", "whose"]) & m.rlike(RUN)).alias("who_name"), flag(any_of(q, ["when"]) & m.rlike(TEMPORAL)).alias("when_time"),
        flag(any_of(q, ["how many", "how much"]) & m.rlike(r"\b[0-9]+")).alias("how_many_number"), flag(any_of(q, ["where"]) & any_of(low, PLACES)).alias("where_place"),
        F.round(some(F.least(count / 5, F.lit(1.0))), 6).alias("evidence_count"), F.round(some(F.least(lengths / count / 30, F.lit(1.0))), 6).alias("evidence_length"),
        F.round(some(F.when(F.size(w) > 0, covered / F.size(w)).otherwise(0.0)), 6).alias("evidence_cover"),
        flag(F.size(words_of(a)) > 1).alias("several_words"), flag(a.rlike(r"^\p{Lu}")).alias("capital"), flag(a.rlike(r"[.!?]$")).alias("end_mark"), flag(F.arrays_overlap(words_of(low), F.array(*[F.lit(x) for x in ASKING]))).alias("asks"),
    )


def fallback_answer(e: DataFrame) -> Column:
    """The first name, year or date, or number of the evidence that a question of who, when or how many asks for; '' if none."""
    q = F.lower("question")
    kinds = [(any_of(q, ["who", "whom"]), RUN), (any_of(q, ["when"]), DATE), (any_of(q, ["how many", "how much"]), r"\b[0-9]+\b")]
    per = F.transform("sentences", lambda s: F.coalesce(*[F.when(asked, F.get(F.regexp_extract_all(masked(s), F.lit(p), F.lit(0)), F.lit(0))) for asked, p in kinds]))
    return F.coalesce(F.get(F.filter(per, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def finalized(e: DataFrame, keep: float = 0.6) -> DataFrame:
    """id, final, how: an answer that the evidence holds, or whose words it holds to `keep`, is kept; else the best span of
    the evidence (likeness to the question over 0.1), else what the question's kind asks for, else the answer as it is."""
    held = F.contains(F.col("low"), F.lower("answer"))
    score = F.when(held, 0.9).otherwise(answer_share(F.col("answer"), F.col("text")))
    kept = (F.col("answer") == "") | (F.size("sentences") == 0) | held | (score >= keep)
    span = best_question_span(e.where(~kept)).where("score > 0.1").select("id", "span")
    j = e.withColumn("kept", kept).withColumn("fallback", fallback_answer(e)).join(span, "id", "left")
    how = F.when(F.col("kept"), "kept").when(F.col("span").isNotNull(), "span").when(F.col("fallback") != "", "pattern").otherwise("kept_without_evidence")
    return j.withColumn("how", how).select("id", F.when(F.col("how") == "span", F.col("span")).when(F.col("how") == "pattern", F.col("fallback")).otherwise(F.col("answer")).alias("final"), "how")


# Forms of spans.
SPAN_PATTERNS = [r'"([^"]+)"', r"'([^']+)'"], [r"\b[0-9]+(?:\.[0-9]+)?\b", r"\b[0-9]{4}\b", r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}\b", r"\b\w+ [0-9]{1,2}, [0-9]{4}\b", RUN]


def span_candidates(t: Column, least: int = 1, most: int = 5) -> Column:
    """The spans of a sentence, each once: runs of `least` to `most` words, quoted parts, numbers, years, dates and names."""
    w = words_of(t)

    def runs(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    quoted = [F.regexp_extract_all(masked(t), F.lit(p), F.lit(1)) for p in SPAN_PATTERNS[0]]
    formed = [F.regexp_extract_all(masked(t), F.lit(p), F.lit(0)) for p in SPAN_PATTERNS[1]]
    return F.array_distinct(F.concat(*[runs(n) for n in range(least, most + 1)], *quoted, *formed))


def best_question_span(e: DataFrame) -> DataFrame:
    """id, span, score: the span of the evidence most like the question (word overlap); of equal ones that of the earlier
    sentence, then the shorter, then by text."""
    rows = e.select("id", "question", F.posexplode("sentences").alias("n", "s")).select("id", "question", "n", F.explode(span_candidates(F.col("s"))).alias("span"))
    scored = rows.select("id", "n", "span", F.round(tx.jaccard(tx.word_set(F.col("question")), tx.word_set(F.col("span"))), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "n", F.char_length("span"), "span")
    return scored.withColumn("p", F.row_number().over(w)).where("p = 1").select("id", "span", "score")


def span_features(e: DataFrame) -> DataFrame:
    """id, span and features of the best span: words (10 at most), where it begins in its sentence, flags of the kind asked
    for, of its form and of what stands around it."""
    rows = e.select("id", "question", F.posexplode("sentences").alias("n", "s"))
    best = best_question_span(e)
    j = rows.join(best, "id").where(F.contains(F.col("s"), F.col("span")))
    j = j.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("n"))).where("p = 1")
    q, low, span = F.lower("question"), F.lower("s"), F.col("span")
    at = F.expr("instr(lower(s), lower(span))")
    name, number, date = span.rlike(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*$"), span.rlike(r"\b[0-9]+"), span.rlike(r"[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}")
    before = lambda w: flag(F.contains(low, F.lit(w)) & (F.instr(low, w) < at))
    return j.select(
        "id", "span", F.least(F.size(words_of(span)), F.lit(10)).alias("n_words"), F.round((at - 1) / F.char_length("s"), 6).alias("position"),
        flag(any_of(q, ["who", "whom", "whose"]) & name).alias("who_name"), flag(any_of(q, ["when"]) & date).alias("when_date"), flag(any_of(q, ["how many", "how much"]) & number).alias("how_many_number"),
        flag(name).alias("is_name"), flag(number).alias("is_number"), flag(date).alias("is_date"), flag(span.rlike('^".*"$')).alias("is_quoted"), flag(span.rlike(r"^\p{Lu}")).alias("capital"),
        flag(F.arrays_overlap(words_of(F.lower(span)), F.array(F.lit("the"), F.lit("a"), F.lit("an")))).alias("article"), before(" is ").alias("is_before"), before(" was ").alias("was_before"), flag(F.contains(low, F.concat(F.lower(span), F.lit(",")))).alias("comma_after"),
    )


def sentence_features(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, idx, sentence_no, overlap with the question (without stop words), flags of the question, of the sentence, the ratio
    of their lengths (5 at most) and of their form."""
    rows = p.select(F.col("item_id").alias("id"), "idx", F.posexplode(tx.sentences(F.col("paragraph_text"))).alias("sentence_no", "s")).join(q.select("id", F.coalesce("question", F.lit("")).alias("question")), "id")
    ql, low, s = F.lower("question"), F.lower("s"), F.col("s")
    m = masked(s)
    return rows.select(
        "id", "idx", "sentence_no", F.round(overlap(F.col("question"), s, QUESTION_STOPS), 6).alias("overlap"), *[flag(any_of(ql, [w])).alias(f"asks_{w}") for w in ASKING],
        flag(m.rlike(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")).alias("person"), flag(m.rlike(DATE)).alias("date"), flag(m.rlike(r"\b[0-9]+\b")).alias("number"), flag(any_of(low, [*PLACES, "state"])).alias("place"),
        flag(low.rlike(" (is|was|are|were) ")).alias("states"), flag(any_of(low, DEEDS)).alias("deed"), flag(any_of(low, KIN)).alias("kin"),
        F.round(F.least(F.size(words_of(s)) / F.greatest(F.size(words_of(F.col("question"))), F.lit(1)), F.lit(5.0)), 6).alias("length_ratio"),
        flag(F.contains(F.col("question"), F.lit("?"))).alias("question_mark"), flag(F.contains(s, F.lit(","))).alias("comma"), flag(F.contains(s, F.lit("(")) & F.contains(s, F.lit(")"))).alias("parentheses"), flag(s.rlike("[\"']")).alias("quotes"),
    )


def best_sentence(f: DataFrame) -> DataFrame:
    """id, idx, sentence_no, overlap: the sentence of each passage that overlaps most with the question, the earliest of equal
    ones; passages without any overlap stay out. f: sentence_features."""
    w = Window.partitionBy("id", "idx").orderBy(F.desc("overlap"), "sentence_no")
    return f.where("overlap > 0").withColumn("p", F.row_number().over(w)).where("p = 1").select("id", "idx", "sentence_no", "overlap")


def support_entities(t: Column) -> Column:
    """Names, years, numbers and acronyms of two characters and more that are no stop words, each once."""
    patterns = [RUN, r"\b[0-9]{4}\b", r"\b[0-9]+(?:\.[0-9]+)?\b", r"\b[A-Z]{2,}\b"]
    every = F.array_distinct(F.concat(*[F.regexp_extract_all(masked(t), F.lit(p), F.lit(0)) for p in patterns]))
    return F.filter(every, lambda x: (F.char_length(x) >= 2) & ~F.lower(x).isin(NO_ENTITIES))


def passage_entities(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, idx, text, ents, asked (entities of the question), question, answer, place (from 0, by idx), staged."""
    rows = p.select(F.col("item_id").alias("id"), "idx", F.coalesce("paragraph_text", F.lit("")).alias("text"))
    own = q.select("id", F.coalesce("question", F.lit("")).alias("question"), F.lower(F.trim(F.coalesce("predicted_answer", F.lit("")))).alias("answer"))
    j = rows.join(own, "id").withColumn("ents", support_entities(F.col("text"))).withColumn("asked", support_entities(F.col("question")))
    return stage(j.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("idx")) - 1), "passage-entities")


def holding(e: DataFrame) -> DataFrame:
    """id, idx, rank: the passages that hold the answer, by idx; where none does, the best three of those that hold over half
    of its words of three letters and more."""
    exact = (F.col("answer") != "") & F.contains(F.lower("text"), F.col("answer"))
    words = F.array_distinct(F.filter(tx.tokens(F.col("answer")), lambda w: F.char_length(w) > 2))
    ratio = F.when(F.size(words) > 0, F.size(F.array_intersect(words, tx.tokens(F.col("text")))) / F.size(words)).otherwise(0.0)
    w = Window.partitionBy("id")
    r = e.select("id", "idx", exact.alias("exact"), F.round(ratio, 6).alias("ratio")).withColumn("any", F.max("exact").over(w))
    r = r.where(F.col("exact") | (~F.col("any") & (F.col("ratio") > 0.5)))
    r = r.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.when(F.col("any"), F.lit(1.0)).otherwise(F.col("ratio"))), "idx")))
    return r.where(F.col("any") | (F.col("rank") <= 3)).select("id", "idx", "rank")


def entity_anchor(e: DataFrame) -> DataFrame:
    """id, anchor: the passage that shares most entities with the question, the first of equal ones."""
    shared = F.size(F.array_intersect("ents", "asked"))
    return e.groupBy("id").agg(F.max(F.struct(shared.alias("n"), (-F.col("idx")).alias("i"))).alias("m")).select("id", (-F.col("m.i")).alias("anchor"))


def entity_passage_graph(e: DataFrame) -> DataFrame:
    """id, a, b: passages of an item that share an entity, a before b. Pairs are made inside items only."""
    a, b = e.select("id", F.col("idx").alias("a"), F.col("ents").alias("x")), e.select("id", F.col("idx").alias("b"), F.col("ents").alias("y"))
    return a.join(b, "id").where("a < b").where(F.arrays_overlap("x", "y")).select("id", "a", "b")


def required_k(e: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """id, k: passages on the shortest way over shared entities from the question's passage to the answer's, between `least`
    and `most`; `least` where one is unknown, they are the same or no way joins them."""
    ends = entity_anchor(e).join(holding(e).where("rank = 1").select("id", F.col("idx").alias("goal")), "id", "left")
    g = entity_passage_graph(e)
    both = stage(g.select("id", "a", "b").union(g.select("id", F.col("b"), F.col("a"))).toDF("id", "at", "to"), "entity-edges")
    front = stage(ends.where("goal IS NOT NULL AND anchor != goal").select("id", F.col("anchor").alias("at"), "goal"), "k-front")
    seen, found, step = front.select("id", "at"), None, 1
    while not front.isEmpty():  # no further than the items have passages
        step += 1
        ahead = front.join(both, ["id", "at"]).select("id", F.col("to").alias("at"), "goal").distinct().join(seen, ["id", "at"], "left_anti")
        ahead = stage(ahead, "k-front")
        hit = ahead.where("at = goal").select("id", F.lit(step).alias("n"))
        found = hit if found is None else found.unionByName(hit)
        seen = seen.unionByName(ahead.select("id", "at"))
        front = ahead
    k = F.lit(least) if found is None else F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce("n", F.lit(least))))
    out = ends if found is None else ends.join(found.groupBy("id").agg(F.min("n").alias("n")), "id", "left")
    return out.select("id", k.cast("int").alias("k"))


def complexity_k(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, k: 4 for two or more signs of several hops or question words, 3 for one, else 2; not more than there are passages."""
    low = F.lower(F.coalesce("question", F.lit("")))
    count = lambda words: sum((flag(F.contains(low, F.lit(w))) for w in words), F.lit(0))
    k = F.when((count(MULTI_HOP) >= 2) | (count(ASKING) >= 2), 4).when((count(MULTI_HOP) >= 1) | (count(ASKING) >= 1), 3).otherwise(2)
    n = p.groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return q.select("id", k.alias("k")).join(n, "id").select("id", F.least("k", F.col("n").cast("int")).alias("k"))


def bridging(e: DataFrame, first: DataFrame) -> DataFrame:
    """id, idx, score: each passage but the item's first chosen one by 0.8 times its likeness (entities) to the question and
    to that passage together, and 0.2 over its place from 1. first: id, idx."""
    f = e.join(first, ["id", "idx"]).select("id", F.col("idx").alias("first"), F.col("ents").alias("other"))
    j = e.join(f, "id").where("idx != first")
    return j.select("id", "idx", F.round(0.8 * (tx.jaccard(F.col("ents"), F.col("asked")) + tx.jaccard(F.col("ents"), F.col("other"))) + 0.2 / (F.col("place") + 1), 6).alias("score"))


def completed_support(e: DataFrame, q: DataFrame) -> DataFrame:
    """id, support: first a passage that holds the answer (a named one before the others; else the first named, else the first
    passage), then the named ones that exist, then the best bridging ones, up to the passages required."""
    k = stage(required_k(e), "required-k")
    named = q.select("id", F.posexplode(F.filter("predicted_support_idxs", lambda x: x.isNotNull())).alias("at", "idx")).groupBy("id", "idx").agg(F.min("at").alias("at"))
    rows = e.select("id", "idx", "place").join(holding(e), ["id", "idx"], "left").join(named, ["id", "idx"], "left")
    order = Window.partitionBy("id").orderBy(
        F.when(F.col("rank").isNotNull() & F.col("at").isNotNull(), 0).when(F.col("rank").isNotNull(), 1).when(F.col("at").isNotNull(), 2).otherwise(3),
        F.coalesce(F.col("at"), F.lit(0)), F.coalesce("rank", F.lit(0)), "place",
    )
    rows = stage(rows.withColumn("first", F.row_number().over(order) == 1), "support-rows")
    scored = rows.join(bridging(e, rows.where("first").select("id", "idx")), ["id", "idx"], "left").join(k, "id")
    w = Window.partitionBy("id").orderBy(F.desc("first"), F.col("at").asc_nulls_last(), F.desc("score"), "idx")
    best = scored.withColumn("p", F.row_number().over(w)).where("p <= k")
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "idx"))), lambda x: x["idx"].cast("string")), ",").alias("support"))


def answer_positions(q: DataFrame, p: DataFrame) -> DataFrame:
    """run_name, items, first_holds, k_matches: items whose first named passage holds the answer, and items that name as many
    passages as support it."""
    first = q.select("id", F.get("predicted_support_idxs", F.lit(0)).alias("idx"), F.lower(F.trim(F.coalesce("predicted_answer", F.lit("")))).alias("a"))
    held = first.join(p.select(F.col("item_id").alias("id"), "idx", F.lower(F.coalesce("paragraph_text", F.lit(""))).alias("t")), ["id", "idx"]).where((F.col("a") != "") & F.contains("t", F.col("a"))).select("id", F.lit(1).alias("h"))
    true = p.where("is_supporting").groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("t"))
    n = F.size(F.array_distinct(F.filter(F.coalesce("predicted_support_idxs", F.array().cast("array<int>")), lambda x: x.isNotNull())))
    j = q.select("id", "run_name", n.alias("n")).join(held, "id", "left").join(true, "id", "left")
    return j.groupBy("run_name").agg(F.count(F.lit(1)).alias("items"), F.count("h").alias("first_holds"), F.count_if(F.col("n") == F.coalesce("t", F.lit(0))).alias("k_matches"))


def _e(make):
    return lambda s, d: make(evidence(items(s, d), passages(s, d)))


def _qp(make):
    return lambda s, d: make(items(s, d), passages(s, d))


def _pe(make):
    return lambda s, d: make(passage_entities(items(s, d), passages(s, d)))


QUERIES = {
    "entailment_features": _e(entailment_features),
    "fallback_answers": _e(lambda e: e.select("id", fallback_answer(e).alias("fallback"))),
    "finalized_answers": _e(finalized),
    "best_question_span": _e(best_question_span),
    "span_features": _e(span_features),
    "sentence_features": _qp(sentence_features),
    "best_sentences": _qp(lambda q, p: best_sentence(sentence_features(q, p))),
    "answer_holding_passages": _pe(holding),
    "entity_anchors": _pe(entity_anchor),
    "entity_passage_graph": _pe(entity_passage_graph),
    "required_passages": _pe(required_k),
    "complexity_passages": _qp(complexity_k),
    "completed_support": lambda s, d: completed_support(passage_entities(items(s, d), passages(s, d)), items(s, d)),
    "answer_positions": _qp(answer_positions),
}

_W = f"WITH {sk.QA}, {sk.PASSAGES}"
_EV = f"""ev AS (SELECT qa.id, coalesce(question, '') AS question, coalesce(predicted_answer, '') AS answer, coalesce(list(paragraph_text ORDER BY idx) FILTER (WHERE coalesce(paragraph_text, '') <> ''), []::VARCHAR[]) AS sentences FROM qa LEFT JOIN pa ON pa.item_id = qa.id GROUP BY ALL),
e AS (SELECT *, array_to_string(sentences, ' ') AS text, lower(array_to_string(sentences, ' ')) AS low, lower(question) AS q, {sk.MASKED.format('answer')} AS m, {sk.WORDS.format('answer')} AS w FROM ev)"""
_RE = lambda t, p: f"regexp_matches({t}, '{p}')"
_SHARE = f"CASE WHEN len(w) > 0 AND text <> '' THEN len(list_intersect(w, {sk.WORDS.format('text')})) / len(w)::DOUBLE ELSE 0.0 END"
_FIRST = lambda p: f"regexp_extract_all({sk.MASKED.format('s')}, '{p}')[1]"
_FALLBACK = f"""coalesce(list_filter(list_transform(sentences, lambda s: CASE WHEN {_RE('q', 'who|whom')} AND {_FIRST(RUN)} IS NOT NULL THEN {_FIRST(RUN)} WHEN {_RE('q', 'when')} AND {_FIRST(DATE)} IS NOT NULL THEN {_FIRST(DATE)}
  WHEN {_RE('q', 'how many|how much')} THEN {_FIRST(chr(92) + 'b[0-9]+' + chr(92) + 'b')} END), lambda x: x IS NOT NULL)[1], '')"""
_SPLIT_S = sk.SPLIT.format("s")
_NGRAMS = ", ".join(f"list_transform(range(1, greatest(1, len({_SPLIT_S}) - {n - 2})), lambda i: array_to_string({_SPLIT_S}[i:i + {n - 1}], ' '))" for n in range(1, 6))
_SPANS = f"""sp AS (SELECT id, question, n, unnest(list_distinct(list_concat({_NGRAMS}, {', '.join("regexp_extract_all(" + sk.MASKED.format('s') + ", '" + p.replace("'", "''") + "', 1)" for p in SPAN_PATTERNS[0])}, {', '.join("regexp_extract_all(" + sk.MASKED.format('s') + ", '" + p + "')" for p in SPAN_PATTERNS[1])}))) AS span
  FROM (SELECT id, question, i AS n, sentences[i] AS s FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS i FROM @ROWS))),
bs AS (SELECT id, n, span, round({sk.jaccard(sk.WORDS.format('question'), sk.WORDS.format('span'))}, 6) AS score FROM sp), best AS (SELECT id, span, score FROM bs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, n, length(span), span) = 1)"""
_SF = f"""sr AS (SELECT item_id AS id, idx, {sk.SENTENCES.format('paragraph_text')} AS ss FROM pa), sx AS (SELECT id, idx, i - 1 AS sentence_no, ss[i] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sr)),
sf AS (SELECT sx.id, idx, sentence_no::INTEGER AS sentence_no, s, lower(s) AS low, {sk.MASKED.format('s')} AS m, coalesce(question, '') AS question, lower(coalesce(question, '')) AS q FROM sx JOIN qa USING (id)),
so AS (SELECT *, round({sk.jaccard(sk.without(sk.WORDS.format('question'), QUESTION_STOPS), sk.without(sk.WORDS.format('s'), QUESTION_STOPS))}, 6) AS overlap FROM sf)"""
_ENT = lambda t: "list_filter(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all({sk.MASKED.format(t)}, '{p}')" for p in [RUN, "\\b[0-9]{4}\\b", "\\b[0-9]+(?:\\.[0-9]+)?\\b", "\\b[A-Z]{2,}\\b"]) + f")), lambda x: length(x) >= 2 AND NOT list_contains({sk.quoted(NO_ENTITIES)}, lower(x)))"
_PE = f"""pe AS (SELECT qa.id, idx, coalesce(paragraph_text, '') AS text, lower(trim(coalesce(predicted_answer, ''))) AS answer, {_ENT('paragraph_text')} AS ents, {_ENT('question')} AS asked, predicted_support_idxs, row_number() OVER (PARTITION BY qa.id ORDER BY idx) - 1 AS place FROM pa JOIN qa ON pa.item_id = qa.id),
aw AS (SELECT *, answer <> '' AND contains(lower(text), answer) AS exact, list_distinct(list_filter({sk.TOKENS.format('answer')}, lambda w: length(w) > 2)) AS aws FROM pe),
ho0 AS (SELECT id, idx, exact, round(CASE WHEN len(aws) > 0 THEN len(list_intersect(aws, {sk.TOKENS.format('text')})) / len(aws)::DOUBLE ELSE 0.0 END, 6) AS ratio, bool_or(exact) OVER (PARTITION BY id) AS has FROM aw),
ho AS (SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN has THEN 1.0 ELSE ratio END DESC, idx)::INTEGER AS rank FROM ho0 WHERE exact OR (NOT has AND ratio > 0.5) QUALIFY has OR rank <= 3),
anc AS (SELECT id, arg_max(idx, (len(list_intersect(ents, asked)), -idx)) AS anchor FROM pe GROUP BY id), eg AS (SELECT a.id, a.idx AS a, b.idx AS b FROM pe a JOIN pe b ON a.id = b.id AND a.idx < b.idx AND list_has_any(a.ents, b.ents))"""
_REQ = """en AS (SELECT anc.id, anchor, ho.idx AS goal FROM anc LEFT JOIN ho ON ho.id = anc.id AND rank = 1), eu AS (SELECT id, a, b FROM eg UNION ALL SELECT id, b, a FROM eg),
s2 AS (SELECT DISTINCT en.id, b AS pos, goal FROM en JOIN eu ON en.id = eu.id AND anchor = a WHERE anchor <> goal), s3 AS (SELECT DISTINCT s2.id, b AS pos, goal FROM s2 JOIN eu ON s2.id = eu.id AND pos = a),
rk AS (SELECT en.id, CASE WHEN goal IS NULL OR anchor = goal THEN 2 WHEN EXISTS (SELECT 1 FROM s2 WHERE s2.id = en.id AND pos = s2.goal) THEN 2 WHEN EXISTS (SELECT 1 FROM s3 WHERE s3.id = en.id AND pos = s3.goal) THEN 3
  WHEN EXISTS (SELECT 1 FROM reach r WHERE r.id = en.id AND r.pos = en.goal) THEN 4 ELSE 2 END::INTEGER AS k FROM en)"""
_REACH = "reach AS (SELECT en.id, anchor AS pos FROM en UNION SELECT reach.id, eu.b FROM reach JOIN eu ON eu.id = reach.id AND eu.a = reach.pos)"
_RK = f"{_W.replace('WITH', 'WITH RECURSIVE', 1)}, {_PE}, " + _REQ.replace("s2 AS (", _REACH + ",\ns2 AS (", 1)
_COUNT = lambda words: " + ".join(f"contains(l, '{w}')::INT" for w in words)

SQL = {
    "entailment_features": f"""{_W}, {_EV} SELECT id, least(len({sk.SPLIT.format('answer')}), 20)::INTEGER AS n_words, round({sk.jaccard(sk.without(sk.WORDS.format('question'), STOPS), sk.without('w', STOPS))}, 6) AS question_likeness, round({_SHARE}, 6) AS evidence_share, contains(low, lower(answer))::INT AS verbatim,
  ({_RE('q', 'who|whom|whose')} AND {_RE('m', RUN)})::INT AS who_name, ({_RE('q', 'when')} AND {_RE('m', TEMPORAL)})::INT AS when_time, ({_RE('q', 'how many|how much')} AND {_RE('m', chr(92) + 'b[0-9]+')})::INT AS how_many_number, ({_RE('q', 'where')} AND {_RE('lower(answer)', '|'.join(PLACES))})::INT AS where_place,
  round(least(len(sentences) / 5.0::DOUBLE, 1.0), 6) AS evidence_count, round(CASE WHEN len(sentences) > 0 THEN least(list_sum(list_transform(sentences, lambda s: len({_SPLIT_S}))) / len(sentences)::DOUBLE / 30, 1.0) ELSE 0.0 END, 6) AS evidence_length,
  round(CASE WHEN len(sentences) > 0 AND len(w) > 0 THEN len(list_filter(w, lambda x: contains(low, x))) / len(w)::DOUBLE ELSE 0.0 END, 6) AS evidence_cover, (len({sk.SPLIT.format('answer')}) > 1)::INT AS several_words, regexp_matches(answer, '^\\p{{Lu}}')::INT AS capital,
  regexp_matches(answer, '[.!?]$')::INT AS end_mark, list_has_any({sk.SPLIT.format('lower(answer)')}, {sk.quoted(ASKING)})::INT AS asks FROM e""",
    "fallback_answers": f"{_W}, {_EV} SELECT id, {_FALLBACK} AS fallback FROM e",
    "finalized_answers": f"""{_W}, {_EV}, ek AS (SELECT *, answer = '' OR len(sentences) = 0 OR contains(low, lower(answer)) OR {_SHARE} >= 0.6 AS kept FROM e), el AS (SELECT * FROM ek WHERE NOT kept), {_SPANS.replace('@ROWS', 'el')},
h AS (SELECT ek.id, answer, best.span, {_FALLBACK} AS fallback, CASE WHEN kept THEN 'kept' WHEN best.score > 0.1 THEN 'span' WHEN {_FALLBACK} <> '' THEN 'pattern' ELSE 'kept_without_evidence' END AS how FROM ek LEFT JOIN best USING (id))
SELECT id, CASE how WHEN 'span' THEN span WHEN 'pattern' THEN fallback ELSE answer END AS final, how FROM h""",
    "best_question_span": f"{_W}, {_EV}, {_SPANS.replace('@ROWS', 'e')} SELECT * FROM best",
    "span_features": f"""{_W}, {_EV}, {_SPANS.replace('@ROWS', 'e')}, r AS (SELECT e.id, q, span, i, sentences[i] AS s FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS i FROM e) e JOIN best ON best.id = e.id), f AS (SELECT *, lower(s) AS low, strpos(lower(s), lower(span)) AS pos FROM r WHERE contains(s, span) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1)
SELECT id, span, least(len({sk.SPLIT.format('span')}), 10)::INTEGER AS n_words, round((pos - 1) / length(s)::DOUBLE, 6) AS position, ({_RE('q', 'who|whom|whose')} AND regexp_full_match(span, '[A-Z][a-z]+(\\s+[A-Z][a-z]+)*'))::INT AS who_name,
  ({_RE('q', 'when')} AND {_RE('span', '[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}')})::INT AS when_date, ({_RE('q', 'how many|how much')} AND {_RE('span', chr(92) + 'b[0-9]+')})::INT AS how_many_number, regexp_full_match(span, '[A-Z][a-z]+(\\s+[A-Z][a-z]+)*')::INT AS is_name, {_RE('span', chr(92) + 'b[0-9]+')}::INT AS is_number,
  {_RE('span', '[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}')}::INT AS is_date, regexp_full_match(span, '".*"')::INT AS is_quoted, {_RE('span', '^' + chr(92) + 'p{Lu}')}::INT AS capital, list_has_any({sk.SPLIT.format('lower(span)')}, ['the', 'a', 'an'])::INT AS article,
  (contains(low, ' is ') AND strpos(low, ' is ') < pos)::INT AS is_before, (contains(low, ' was ') AND strpos(low, ' was ') < pos)::INT AS was_before, contains(low, lower(span) || ',')::INT AS comma_after FROM f""",
    "sentence_features": f"""{_W}, {_SF} SELECT id, idx, sentence_no, overlap, {', '.join(f"contains(q, '{w}')::INT AS asks_{w}" for w in ASKING)}, {_RE('m', chr(92) + 'b[A-Z][a-z]+ [A-Z][a-z]+' + chr(92) + 'b')}::INT AS person, {_RE('m', DATE)}::INT AS date, {_RE('m', chr(92) + 'b[0-9]+' + chr(92) + 'b')}::INT AS number,
  {_RE('low', '|'.join([*PLACES, 'state']))}::INT AS place, {_RE('low', ' (is|was|are|were) ')}::INT AS states, {_RE('low', '|'.join(DEEDS))}::INT AS deed, {_RE('low', '|'.join(KIN))}::INT AS kin, round(least(len({_SPLIT_S}) / greatest(len({sk.SPLIT.format('question')}), 1)::DOUBLE, 5.0), 6) AS length_ratio,
  contains(question, '?')::INT AS question_mark, contains(s, ',')::INT AS comma, (contains(s, '(') AND contains(s, ')'))::INT AS parentheses, regexp_matches(s, '["'']')::INT AS quotes FROM so""",
    "best_sentences": f"{_W}, {_SF} SELECT id, idx, sentence_no, overlap FROM so WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY id, idx ORDER BY overlap DESC, sentence_no) = 1",
    "answer_holding_passages": f"{_W}, {_PE} SELECT * FROM ho",
    "entity_anchors": f"{_W}, {_PE} SELECT * FROM anc",
    "entity_passage_graph": f"{_W}, {_PE} SELECT * FROM eg",
    "required_passages": f"{_RK} SELECT * FROM rk",
    "complexity_passages": f"""{_W}, l AS (SELECT id, lower(coalesce(question, '')) AS l FROM qa), n AS (SELECT item_id AS id, count(*) AS n FROM pa GROUP BY item_id), c AS (SELECT id, n, {_COUNT(MULTI_HOP)} AS a, {_COUNT(ASKING)} AS b FROM l JOIN n USING (id))
SELECT id, least(CASE WHEN a >= 2 OR b >= 2 THEN 4 WHEN a >= 1 OR b >= 1 THEN 3 ELSE 2 END, n)::INTEGER AS k FROM c""",
    "completed_support": f"""{_RK}, nm0 AS (SELECT id, unnest(list_filter(predicted_support_idxs, lambda x: x IS NOT NULL)) AS idx, generate_subscripts(list_filter(predicted_support_idxs, lambda x: x IS NOT NULL), 1) AS pos FROM qa), nm AS (SELECT id, idx, min(pos) AS pos FROM nm0 GROUP BY ALL),
rw AS (SELECT pe.*, ho.rank, nm.pos FROM pe LEFT JOIN ho USING (id, idx) LEFT JOIN nm USING (id, idx)),
fi AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN rank IS NOT NULL AND pos IS NOT NULL THEN 0 WHEN rank IS NOT NULL THEN 1 WHEN pos IS NOT NULL THEN 2 ELSE 3 END, coalesce(pos, 0), coalesce(rank, 0), place) = 1 AS first FROM rw), f1 AS (SELECT id, ents AS other FROM fi WHERE first),
sc AS (SELECT fi.id, idx, first, pos, CASE WHEN NOT first THEN round(0.8::DOUBLE * ({sk.jaccard('ents', 'asked')} + {sk.jaccard('ents', 'other')}) + 0.2::DOUBLE / (place + 1), 6) END AS score FROM fi JOIN f1 USING (id)),
pk AS (SELECT sc.id, idx, row_number() OVER (PARTITION BY sc.id ORDER BY first DESC, pos NULLS LAST, score DESC, idx) AS p, k FROM sc JOIN rk USING (id) QUALIFY p <= k) SELECT id, string_agg(idx::VARCHAR, ',' ORDER BY p) AS support FROM pk GROUP BY id""",
    "answer_positions": f"""{_W}, h AS (SELECT DISTINCT qa.id FROM qa JOIN pa ON pa.item_id = qa.id AND pa.idx = predicted_support_idxs[1] WHERE trim(coalesce(predicted_answer, '')) <> '' AND contains(lower(coalesce(paragraph_text, '')), lower(trim(predicted_answer)))),
t AS (SELECT item_id AS id, count(*) AS t FROM pa WHERE is_supporting GROUP BY item_id) SELECT run_name, count(*) AS items, count(h.id) AS first_holds, count(*) FILTER (WHERE len(list_distinct(list_filter(coalesce(predicted_support_idxs, []::INTEGER[]), lambda x: x IS NOT NULL))) = coalesce(t, 0)) AS k_matches
FROM qa LEFT JOIN h ON h.id = qa.id LEFT JOIN t ON t.id = qa.id GROUP BY run_name""",
}
