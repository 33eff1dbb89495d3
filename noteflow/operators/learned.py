"""Learned scorers on question-passage features: a pipeline of scaler and logistic regression or a small network."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.operators.evaluation import items, passages, question_passage_scores

FEATURES = ["jaccard", "best_sentence", "keyword", "position", "log_length", "title_overlap", "holds"]
#: Rows that a model is fitted on, at most.
FIT_ROWS = 200_000


def passage_features(q: DataFrame, p: DataFrame) -> DataFrame:
    """id, idx, FEATURES, label (1.0 if the passage supports, null if unknown)."""
    s = question_passage_scores(q, p)
    meta = p.select(F.col("item_id").alias("id"), "idx", "title", "paragraph_text", "is_supporting").join(q.select("id", "question"), "id")
    meta = meta.select(
        "id", "idx", (1 / (F.col("idx") + 1.0)).alias("position"), F.log1p(F.char_length(F.coalesce("paragraph_text", F.lit("")))).alias("log_length"),
        tx.jaccard(tx.word_set(F.col("question")), tx.word_set(F.col("title"))).alias("title_overlap"), F.col("is_supporting").cast("double").alias("label"),
    )
    return s.withColumn("holds", F.col("contains_answer").cast("double")).drop("contains_answer").join(meta, ["id", "idx"])


def held_out(key: str = "id"):
    """True for a fifth of the items, by their hash."""
    return F.pmod(F.xxhash64(key), F.lit(5)) == 0


def fit_scorer(features: DataFrame, kind: str = "logistic", rows: int = FIT_ROWS) -> PipelineModel:
    """Fitted on at most `rows` labelled rows, chosen by hash."""
    known = features.where("label IS NOT NULL")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("id", "idx"), F.lit(n)) < rows)
    parts = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    model = LogisticRegression(maxIter=50, regParam=0.01) if kind == "logistic" else MultilayerPerceptronClassifier(layers=[len(FEATURES), 16, 2], seed=7, maxIter=60)
    return Pipeline(stages=[*parts, model]).fit(known)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """id, idx, score: the probability that the passage supports the answer."""
    return model.transform(features).select("id", "idx", F.round(vector_to_array("probability")[1], 6).alias("score"), "label")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = passage_features(items(spark, sf_dir), passages(spark, sf_dir))
    return score(fit_scorer(f.where(~held_out())), f).select("id", "idx", "score")


QUERIES = {"learned_passage_scores": _scored}
SQL: dict[str, str] = {}
