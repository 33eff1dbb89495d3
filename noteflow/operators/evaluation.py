"""Operators on questions, answers and their passages: support, coverage, metrics, audits of batch runs, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import table
from noteflow.operators.references import latest

# What no answer may say.
FORBIDDEN = ["no answer", "insufficient information", "cannot be determined", "unanswerable", "not stated", "unknown", "insufficient evidence", "processing failed", "error occurred"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_results, each once as delivered last."""
    return latest(table(spark, sf_dir, "qa_results"), ["id"])


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paragraphs, each once as delivered last, deleted ones left out."""
    return latest(table(spark, sf_dir, "paragraphs"), ["item_id", "idx"]).where("deleted_at IS NULL")


def official_format(q: DataFrame) -> DataFrame:
    """id, predicted_answer ('' if null), predicted_support (idxs in order, each once, joined), predicted_answerable
    (true if null); rows without an id are left out."""
    idxs = F.array_distinct(F.filter(F.coalesce("predicted_support_idxs", F.array().cast("array<int>")), lambda x: x.isNotNull()))
    return q.where("id IS NOT NULL").select(
        "id", F.coalesce("predicted_answer", F.lit("")).alias("predicted_answer"), F.array_join(idxs, ",").alias("predicted_support"),
        F.coalesce("predicted_answerable", F.lit(True)).alias("predicted_answerable"),
    )


def first_items(q: DataFrame, k: int = 200) -> DataFrame:
    """The first k items with an id and a question, by time of prediction, then id (a development set)."""
    return q.where(F.col("id").isNotNull() & ~tx.blank(F.col("question"))).orderBy("predicted_at", "id").limit(k).select("id", "question")


def support_lengths(q: DataFrame) -> DataFrame:
    """run_name, length (0, 1, 2, 3 or 3+), n: how many support passages answers name."""
    n = F.size(F.filter(F.coalesce("predicted_support_idxs", F.array().cast("array<int>")), lambda x: x.isNotNull()))
    return q.groupBy("run_name", F.when(n > 3, F.lit("3+")).otherwise(n.cast("string")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def answer_audit(q: DataFrame) -> DataFrame:
    """Per run: items, share of empty answers, share with a forbidden phrase, share called answerable."""
    a = F.lower(F.coalesce("predicted_answer", F.lit("")))
    forbidden = F.lit(False)
    for p in FORBIDDEN:
        forbidden = forbidden | F.contains(a, F.lit(p))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return q.groupBy("run_name").agg(F.count(F.lit(1)).alias("items"), share(tx.blank(F.col("predicted_answer"))).alias("empty"), share(forbidden).alias("forbidden"), share(F.coalesce("predicted_answerable", F.lit(True))).alias("answerable"))


def support_metrics(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, n_true, n_predicted, n_hit, precision, recall, f1 of the support passages. Without true and predicted ones
    all are 1; with true ones only, all are 0; with predicted ones only, recall is 1 and the rest 0."""
    true = p.where("is_supporting").select(F.col("item_id").alias("id"), "idx", F.lit(1).alias("t"), F.lit(0).alias("g"))
    guess = q.select("id", F.explode(F.array_distinct("predicted_support_idxs")).alias("idx")).where("idx IS NOT NULL").select("id", "idx", F.lit(0).alias("t"), F.lit(1).alias("g"))
    one = true.unionByName(guess).groupBy("id", "idx").agg(F.max("t").alias("t"), F.max("g").alias("g"))
    s = one.groupBy("id").agg(F.sum("t").alias("n_true"), F.sum("g").alias("n_predicted"), F.sum(F.col("t") * F.col("g")).alias("n_hit"))
    s = q.select("id").join(s, "id", "left").fillna(0, ["n_true", "n_predicted", "n_hit"])
    precision = F.when(F.col("n_predicted") > 0, F.col("n_hit") / F.col("n_predicted")).when(F.col("n_true") > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    recall = F.when(F.col("n_true") > 0, F.col("n_hit") / F.col("n_true")).otherwise(F.lit(1.0))
    s = s.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6))
    f1 = F.when((F.col("n_true") == 0) & (F.col("n_predicted") == 0), F.lit(1.0)).when(F.col("n_hit") > 0, 2.0 * F.col("n_hit") / (F.col("n_true") + F.col("n_predicted"))).otherwise(F.lit(0.0))
    return s.withColumn("f1", F.round(f1, 6))


def run_summary(metrics: DataFrame, q: DataFrame) -> DataFrame:
    """Per run: items and macro averages of precision, recall and f1."""
    m = metrics.join(q.select("id", "run_name"), "id")
    return m.groupBy("run_name").agg(F.count(F.lit(1)).alias("items"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


def question_passage_scores(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, idx, jaccard, best_sentence, keyword, contains_answer: word overlap of the question with each passage, with
    its best sentence and without stop words, and whether the passage holds the answer."""
    j = p.select(F.col("item_id").alias("id"), "idx", "paragraph_text").join(q.select("id", "question", "predicted_answer"), "id")
    qs, ps = tx.word_set(F.col("question")), tx.word_set(F.col("paragraph_text"))
    sent = F.transform(tx.sentences(F.col("paragraph_text")), lambda s: tx.jaccard(tx.word_set(F.col("question")), tx.word_set(s)))
    kw = tx.jaccard(tx.word_set(F.col("question"), tx.STOP_WORDS), tx.word_set(F.col("paragraph_text"), tx.STOP_WORDS))
    answer = F.lower(F.trim(F.coalesce("predicted_answer", F.lit(""))))
    holds = (answer != "") & F.contains(F.lower(F.coalesce("paragraph_text", F.lit(""))), answer)
    return j.select("id", "idx", F.round(tx.jaccard(qs, ps), 6).alias("jaccard"), F.round(F.coalesce(F.array_max(sent), F.lit(0.0)), 6).alias("best_sentence"), F.round(kw, 6).alias("keyword"), holds.alias("contains_answer"))


def best_passage(scores: DataFrame) -> DataFrame:
    """id, idx, score: the passage with the largest 0.5 jaccard + 0.5 best sentence, the earliest of equal ones."""
    s = scores.withColumn("score", F.round(0.5 * F.col("jaccard") + 0.5 * F.col("best_sentence"), 6))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "idx")
    return s.withColumn("p", F.row_number().over(w)).where("p = 1").select("id", "idx", "score")


def filled_support(q: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """id, support: up to k passages of the item - those with the answer first, then the predicted ones, then by 0.8
    overlap + 0.2 / (idx + 1)."""
    named = q.select("id", F.explode(F.array_distinct("predicted_support_idxs")).alias("idx")).where("idx IS NOT NULL").withColumn("named", F.lit(1))
    j = scores.join(named, ["id", "idx"], "left").withColumn("named", F.coalesce("named", F.lit(0)))
    score = F.round(0.8 * F.col("keyword") + 0.2 / (F.col("idx") + 1), 6)
    w = Window.partitionBy("id").orderBy(F.desc(F.col("contains_answer").cast("int")), F.desc("named"), F.desc(score), "idx")
    best = j.withColumn("p", F.row_number().over(w)).where(F.col("p") <= k)
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "idx"))), lambda x: x["idx"].cast("string")), ",").alias("support"))


def entailment(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, score, verdict: 0.9 if some passage holds the answer, else the share of the answer's words that the passages
    hold; supported from 0.6 (such an answer is kept), weak from 0.1, else unsupported. Items without passages or answer
    are unsupported with 0."""
    answer = F.lower(F.trim(F.coalesce("predicted_answer", F.lit(""))))
    j = q.select("id", answer.alias("a"), tx.word_set(F.col("predicted_answer")).alias("w")).join(p.select(F.col("item_id").alias("id"), F.lower(F.coalesce("paragraph_text", F.lit(""))).alias("t")), "id", "left")
    g = j.groupBy("id").agg(
        F.max(F.coalesce((F.col("a") != "") & F.contains("t", F.col("a")), F.lit(False)).cast("int")).alias("c"),
        F.first("w").alias("w"), F.array_distinct(F.flatten(F.collect_list(F.array_intersect("w", tx.word_set(F.col("t")))))).alias("h"),
    )
    score = F.when(F.col("c") == 1, F.lit(0.9)).when(F.size("w") > 0, F.size("h") / F.size("w")).otherwise(F.lit(0.0))
    return g.select("id", F.round(score, 6).alias("score")).withColumn("verdict", F.when(F.col("score") >= 0.6, "supported").when(F.col("score") >= 0.1, "weak").otherwise("unsupported"))


def calibrate(scores: DataFrame, p: DataFrame) -> DataFrame:
    """threshold, accuracy: for a grid of thresholds on the keyword overlap, the share of passages of which being over it
    tells whether they support; one row per threshold."""
    truth = p.select(F.col("item_id").alias("id"), "idx", F.coalesce("is_supporting", F.lit(False)).alias("t"))
    j = scores.select("id", "idx", "keyword").join(truth, ["id", "idx"])
    counts = j.groupBy(*[F.lit(0).alias("z")]).agg(*[F.round(F.avg(((F.col("keyword") >= x / 100) == F.col("t")).cast("int")), 6).alias(str(x)) for x in range(2, 22, 2)])
    pairs = F.array(*[F.struct(F.lit(x / 100).alias("threshold"), F.col(str(x)).alias("accuracy")) for x in range(2, 22, 2)])
    return counts.select(F.explode(pairs).alias("x")).select("x.threshold", "x.accuracy")


def complexity(q: DataFrame) -> DataFrame:
    """id, indicators, complex: a question with two or more of six signs: over ten words, `and`, `or`, several question
    marks, a word of comparison, a question word in over eight words (all but the lengths as parts of the text)."""
    t, low = F.coalesce("question", F.lit("")), F.lower(F.coalesce("question", F.lit("")))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    signs = [
        words > 10, F.contains(low, F.lit("and")), F.contains(low, F.lit("or")), F.char_length(t) - F.char_length(F.replace(t, F.lit("?"), F.lit(""))) > 1,
        low.rlike("compare|difference|relationship|between"), low.rlike("why|how|what|when|where") & (words > 8),
    ]
    n = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    return q.select("id", n.alias("indicators"), (n >= 2).alias("complex"))


def unanswered(q: DataFrame, p: DataFrame) -> DataFrame:
    """item_id of passages whose question has no answer yet: what a resumed run still has to do."""
    done = q.where(~tx.blank(F.col("predicted_answer"))).select(F.col("id").alias("item_id"))
    return p.select("item_id").distinct().join(done, "item_id", "left_anti")


def ghost_support(q: DataFrame, p: DataFrame) -> DataFrame:
    """run_name, items, with_ghosts: items that name a passage which is not there."""
    named = q.select("id", "run_name", F.explode(F.array_distinct("predicted_support_idxs")).alias("idx")).where("idx IS NOT NULL")
    ghosts = named.join(p.select(F.col("item_id").alias("id"), "idx"), ["id", "idx"], "left_anti").select("id").distinct().withColumn("g", F.lit(1))
    return q.select("id", "run_name").join(ghosts, "id", "left").groupBy("run_name").agg(F.count(F.lit(1)).alias("items"), F.count("g").alias("with_ghosts"))


def _qp(make):
    return lambda s, d: make(items(s, d), passages(s, d))


def _i(make):
    return lambda s, d: make(items(s, d))


QUERIES = {
    "official_format": _i(official_format),
    "first_items": _i(first_items),
    "support_lengths": _i(support_lengths),
    "answer_audit": _i(answer_audit),
    "support_metrics": _qp(support_metrics),
    "run_summary": _qp(lambda q, p: run_summary(support_metrics(q, p), q)),
    "passage_chunks": lambda s, d: passages(s, d).select("item_id", "idx", F.coalesce("title", F.lit("")).alias("title"), F.char_length(F.coalesce("paragraph_text", F.lit(""))).alias("length"), "is_supporting"),
    "question_passage_scores": _qp(question_passage_scores),
    "best_passage": _qp(lambda q, p: best_passage(question_passage_scores(q, p))),
    "filled_support": _qp(lambda q, p: filled_support(q, question_passage_scores(q, p))),
    "answer_entailment": _qp(entailment),
    "support_calibration": _qp(lambda q, p: calibrate(question_passage_scores(q, p), p)),
    "question_complexity": _i(complexity),
    "unanswered_items": _qp(unanswered),
    "ghost_support": _qp(ghost_support),
}

_QA = "qa AS (SELECT * FROM qa_results QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_PA = "pa AS (SELECT * FROM (SELECT * FROM paragraphs QUALIFY row_number() OVER (PARTITION BY item_id, idx ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL)"
_W = f"WITH {_QA}, {_PA}"
_BLANK = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '', true)"
_IDX = "list_filter(coalesce(predicted_support_idxs, []::INTEGER[]), lambda x: x IS NOT NULL)"
_ORDERED = "list_filter(" + _IDX + ", lambda x, i: list_position(" + _IDX + ", x) = i)"
_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+')), lambda w: w <> '')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_KEY = "list_filter(" + _WORDS + ", lambda w: NOT list_contains(" + _STOPS + ", w))"
_SENT = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([。！？.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _j(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) - {n} > 0 THEN {n} / (len({a}) + len({b}) - {n})::DOUBLE ELSE 0.0 END"


_METRICS = f"""one AS (SELECT id, idx, max(t) AS t, max(g) AS g FROM (SELECT item_id AS id, idx, 1 AS t, 0 AS g FROM pa WHERE is_supporting UNION ALL SELECT id, unnest({_IDX}), 0, 1 FROM qa) GROUP BY ALL),
s AS (SELECT qa.id, coalesce(sum(t), 0)::BIGINT AS n_true, coalesce(sum(g), 0)::BIGINT AS n_predicted, coalesce(sum(t * g), 0)::BIGINT AS n_hit FROM qa LEFT JOIN one ON qa.id = one.id GROUP BY qa.id),
m AS (SELECT *, round(CASE WHEN n_predicted > 0 THEN n_hit / n_predicted::DOUBLE WHEN n_true > 0 THEN 0.0 ELSE 1.0 END, 6) AS precision, round(CASE WHEN n_true > 0 THEN n_hit / n_true::DOUBLE ELSE 1.0 END, 6) AS recall,
  round(CASE WHEN n_true = 0 AND n_predicted = 0 THEN 1.0 WHEN n_hit > 0 THEN 2.0::DOUBLE * n_hit / (n_true + n_predicted) ELSE 0.0 END, 6) AS f1 FROM s)"""
_SCORES = f"""w AS (SELECT qa.id, pa.idx, {_WORDS.format('question')} AS qs, {_WORDS.format('paragraph_text')} AS ps, {_KEY.format('question')} AS qk, {_KEY.format('paragraph_text')} AS pk,
  list_transform({_SENT.format('paragraph_text')}, lambda s: {_WORDS.format('s')}) AS ss, lower(trim(coalesce(predicted_answer, ''))) AS a, lower(coalesce(paragraph_text, '')) AS t FROM pa JOIN qa ON pa.item_id = qa.id),
sc AS (SELECT id, idx, round({_j('qs', 'ps')}, 6) AS jaccard, round(coalesce(list_max(list_transform(ss, lambda s: {_j('qs', 's')})), 0.0), 6) AS best_sentence, round({_j('qk', 'pk')}, 6) AS keyword, a <> '' AND contains(t, a) AS contains_answer FROM w)"""
_FORB = " OR ".join(f"contains(lower(coalesce(predicted_answer, '')), '{p}')" for p in FORBIDDEN)

SQL = {
    "official_format": f"""{_W} SELECT id, coalesce(predicted_answer, '') AS predicted_answer, array_to_string({_ORDERED}, ',') AS predicted_support, coalesce(predicted_answerable, true) AS predicted_answerable FROM qa WHERE id IS NOT NULL""",
    "first_items": f"""{_W} SELECT id, question FROM qa WHERE id IS NOT NULL AND NOT {_BLANK.format('question')} ORDER BY predicted_at NULLS FIRST, id LIMIT 200""",
    "support_lengths": f"""{_W} SELECT run_name, CASE WHEN len({_IDX}) > 3 THEN '3+' ELSE len({_IDX})::VARCHAR END AS length, count(*) AS n FROM qa GROUP BY ALL""",
    "answer_audit": f"""{_W} SELECT run_name, count(*) AS items, round(avg({_BLANK.format('predicted_answer')}::INT), 6) AS empty, round(avg(({_FORB})::INT), 6) AS forbidden, round(avg(coalesce(predicted_answerable, true)::INT), 6) AS answerable FROM qa GROUP BY run_name""",
    "support_metrics": f"{_W}, {_METRICS} SELECT * FROM m",
    "run_summary": f"{_W}, {_METRICS} SELECT run_name, count(*) AS items, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM m JOIN qa USING (id) GROUP BY run_name",
    "passage_chunks": f"{_W} SELECT item_id, idx, coalesce(title, '') AS title, length(coalesce(paragraph_text, ''))::INTEGER AS length, is_supporting FROM pa",
    "question_passage_scores": f"{_W}, {_SCORES} SELECT * FROM sc",
    "best_passage": f"{_W}, {_SCORES} SELECT id, idx, round(0.5::DOUBLE * jaccard + 0.5::DOUBLE * best_sentence, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) = 1",
    "filled_support": f"""{_W}, {_SCORES}, n AS (SELECT DISTINCT id, unnest({_IDX}) AS idx, 1 AS named FROM qa),
r AS (SELECT sc.id, sc.idx, row_number() OVER (PARTITION BY sc.id ORDER BY contains_answer::INT DESC, coalesce(named, 0) DESC, round(0.8::DOUBLE * keyword + 0.2::DOUBLE / (sc.idx + 1), 6) DESC, sc.idx) AS p FROM sc LEFT JOIN n ON sc.id = n.id AND sc.idx = n.idx QUALIFY p <= 3)
SELECT id, string_agg(idx::VARCHAR, ',' ORDER BY p) AS support FROM r GROUP BY id""",
    "answer_entailment": f"""{_W}, w AS (SELECT id, lower(trim(coalesce(predicted_answer, ''))) AS a, {_WORDS.format('predicted_answer')} AS w FROM qa),
g AS (SELECT w.id, any_value(w) AS w, bool_or(a <> '' AND contains(lower(coalesce(paragraph_text, '')), a)) AS c, list_distinct(flatten(list(list_intersect(w, {_WORDS.format('paragraph_text')})))) AS h FROM w LEFT JOIN pa ON pa.item_id = w.id GROUP BY w.id),
s AS (SELECT id, round(CASE WHEN c THEN 0.9 WHEN len(w) > 0 THEN len(h) / len(w)::DOUBLE ELSE 0.0 END, 6)::DOUBLE AS score FROM g)
SELECT *, CASE WHEN score >= 0.6 THEN 'supported' WHEN score >= 0.1 THEN 'weak' ELSE 'unsupported' END AS verdict FROM s""",
    "support_calibration": f"""{_W}, {_SCORES}, j AS (SELECT keyword, coalesce(is_supporting, false) AS t FROM sc JOIN pa ON sc.id = pa.item_id AND sc.idx = pa.idx)
SELECT x / 100.0::DOUBLE AS threshold, round(avg(((keyword >= x / 100.0::DOUBLE) = t)::INT), 6) AS accuracy FROM j, range(2, 22, 2) r(x) GROUP BY x""",
    "question_complexity": f"""{_W}, x AS (SELECT id, coalesce(question, '') AS t, lower(coalesce(question, '')) AS l, len(list_filter(regexp_split_to_array(coalesce(question, ''), '\\s+'), lambda w: w <> '')) AS n FROM qa),
n AS (SELECT id, (n > 10)::INT + contains(l, 'and')::INT + contains(l, 'or')::INT + (length(t) - length(replace(t, '?', '')) > 1)::INT + regexp_matches(l, 'compare|difference|relationship|between')::INT
  + (regexp_matches(l, 'why|how|what|when|where') AND n > 8)::INT AS indicators FROM x) SELECT *, indicators >= 2 AS complex FROM n""",
    "unanswered_items": f"{_W} SELECT DISTINCT item_id FROM pa WHERE item_id NOT IN (SELECT id FROM qa WHERE NOT {_BLANK.format('predicted_answer')})",
    "ghost_support": f"""{_W}, n AS (SELECT id, unnest({_IDX}) AS idx FROM qa), g AS (SELECT DISTINCT id FROM n WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.item_id = n.id AND pa.idx = n.idx))
SELECT run_name, count(*) AS items, count(g.id) AS with_ghosts FROM qa LEFT JOIN g ON qa.id = g.id GROUP BY run_name""",
}
