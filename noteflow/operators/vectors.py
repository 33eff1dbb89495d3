"""Operators on vectors: norms, similarity, exact search by blocks, an inverted-file index, clusters.

Vectors are packed into blocks of a fixed number of rows and compared as matrices. A search pairs every block of
queries with every block of rows - the stated query set against all rows - and keeps k per query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions.runtime import parallelism, stage, table

BLOCK = 2048
FIT_ROWS = 50_000


def norm(v: Column) -> Column:
    """Euclidean length, in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Dot product, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has no null, NaN or infinite value and is not all zero."""
    e = F.col(column)
    return df.where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0))


def _blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """block, ids, vecs: blocks of at most about BLOCK unit vectors, packed."""
    n = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK))
    count = df.agg(n.cast("int").alias("blocks"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(column).alias("e")).crossJoin(F.broadcast(count)).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        x = np.stack(t.column("e").to_pylist()).astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        return pa.table({"block": t.column("block").slice(0, 1), "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), "vecs": pa.array([x.tobytes()], pa.binary())})

    return rows.select("block", "id", "e").groupBy("block").applyInArrow(pack, "block int, ids array<bigint>, vecs binary")


def search(rows: DataFrame, queries: DataFrame, key: str, column: str, k: int = 10) -> DataFrame:
    """query_id, id, sim, rank: the k rows with the largest cosine to each query, the query's own key left out; ties by
    id. rows and queries: key, column; only usable vectors take part."""
    q, r = stage(_blocks(usable(queries, column), key, column), "query-blocks"), stage(_blocks(usable(rows, column), key, column), "row-blocks")
    pairs = q.select(F.col("ids").alias("qi"), F.col("vecs").alias("qv")).crossJoin(r.select(F.col("ids").alias("ri"), F.col("vecs").alias("rv")))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                qi, ri = (np.array(b.column(c)[i].as_py(), np.int64) for c in ("qi", "ri"))
                qv, rv = (np.frombuffer(b.column(c)[i].as_py(), np.float64).reshape(len(n), -1) for c, n in (("qv", qi), ("rv", ri)))
                s = np.round(qv @ rv.T, 6)
                s[qi[:, None] == ri[None, :]] = -2
                m = min(k, len(ri))
                edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                a, c = np.nonzero((s >= edge[:, None]) & (s > -2))  # with all ties of the k-th, the merge orders them
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ri[c]), pa.array(s[a, c])], ["query_id", "id", "sim"])

    best = pairs.repartition(4 * parallelism(rows.sparkSession)).mapInArrow(run, "query_id bigint, id bigint, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ivf_index(rows: DataFrame, key: str, column: str, cells: int = 16, seed: int = 42) -> tuple[DataFrame, object]:
    """key, column, cell of every usable row, and the fitted model. The centroids are fitted on at most FIT_ROWS rows;
    fewer than two rows a cell halve the number of cells."""
    good = usable(rows, column).select(key, column)
    n = good.count()
    cells = max(1, min(cells, n // 2))
    vector = good.withColumn("features", array_to_vector(unit(F.col(column))))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10).fit(vector.sample(min(1.0, FIT_ROWS / max(n, 1)), seed))
    return model.transform(vector).select(key, column, F.col("prediction").alias("cell")), model


def ivf_search(index: DataFrame, model, queries: DataFrame, key: str, column: str, probes: int, k: int = 10) -> DataFrame:
    """query_id, id, sim, rank: the k best rows of the `probes` cells nearest to each query, the query's own key left out.
    index: as `ivf_index` gives it; rows and queries meet by cell, each cell as one matrix product per block of rows."""
    centres = np.stack(model.clusterCenters())
    kinds = "query_id bigint, e array<float>, cell int"

    def route(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("e").to_pylist()).astype(np.float64)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
                n = min(probes, len(centres))
                cells = np.argsort(d, axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(len(x)), n))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("e").take(at), pa.array(cells.ravel(), pa.int32())], ["query_id", "e", "cell"])

    asked = usable(queries, column).select(F.col(key).cast("bigint").alias("query_id"), F.col(column).cast("array<float>").alias("e")).mapInArrow(route, kinds)
    # large cells are cut into parts, and their queries repeated
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = index.join(sizes, "cell").select(F.col("cell").alias("c"), F.pmod(F.xxhash64(key), "parts").cast("int").alias("part"), F.col(key).cast("bigint").alias("id"), F.col(column).alias("v"))
    asked = asked.join(sizes, "cell").select("cell", "query_id", "e", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        x, y = (np.stack(t.column(c).to_pylist()).astype(np.float64) for t, c in ((q, "e"), (r, "v")))
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        y /= np.sqrt((y * y).sum(axis=1))[:, None]
        qi, ri = q.column("query_id").to_numpy(), r.column("id").to_numpy()
        s = np.round(x @ y.T, 6)
        s[qi[:, None] == ri[None, :]] = -2
        edge = -np.partition(-s, min(k, len(ri)) - 1, axis=1)[:, min(k, len(ri)) - 1]
        a, c = np.nonzero((s >= edge[:, None]) & (s > -2))
        return pa.table({"query_id": qi[a], "id": ri[c], "sim": s[a, c]})

    best = asked.groupBy("cell", "p").cogroup(rows.groupBy("c", "part")).applyInArrow(run, "query_id bigint, id bigint, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tune_probes(rows: DataFrame, queries: DataFrame, key: str, column: str, target: float = 0.9, choices=(1, 2, 4, 8, 16)) -> tuple[int, list[tuple[int, float]]]:
    """The fewest probes whose recall against the exact search reaches `target` (the most if none does), and what was
    measured. One run per choice; only its recall comes to the driver."""
    index, model = ivf_index(rows, key, column)
    index = stage(index, "ivf")
    exact = stage(search(rows, queries, key, column).select("query_id", "id"), "exact")
    total = exact.count()
    tried = []
    for n in choices:
        hits = ivf_search(index, model, queries, key, column, n).select("query_id", "id").join(exact, ["query_id", "id"], "left_semi").count()
        tried.append((n, hits / total if total else 1.0))
        if tried[-1][1] >= target:
            break
    return tried[-1][0], tried


def label_centroids(df: DataFrame, column: str, label: str) -> DataFrame:
    """label, size, centroid_norm, spread: per label the length of its mean vector and the mean squared distance from it.
    Sums per label and position are combined map-side."""
    pos = df.select(label, F.posexplode(column).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    m = pos.groupBy(label, "i").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(label).agg(F.max("n").alias("size"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("centroid_norm"), F.round(F.sum(F.col("q") - F.col("m") * F.col("m")), 6).alias("spread"))


def threshold_grid(hits: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """threshold, kept, right, precision of the hits over each of nine thresholds; a hit is right if it has its query's label."""
    l = labels.select(F.col(key), F.col(label).alias("l"))
    j = hits.join(l.select(F.col(key).alias("query_id"), F.col("l").alias("ql")), "query_id").join(l.select(F.col(key).alias("id"), F.col("l").alias("hl")), "id")
    g = j.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(x / 10) for x in range(1, 10)]), lambda t: F.col("sim") >= t)))
    return g.groupBy("threshold").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("ql") == F.col("hl")).alias("right")).withColumn("precision", F.round(F.col("right") / F.col("kept"), 6))


def elbow(points: DataFrame) -> DataFrame:
    """The k with the largest second difference of `inertia` over `k`; one row, none for fewer than three points."""
    w = Window.orderBy("k")
    d = points.withColumn("bend", F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)).where("bend IS NOT NULL")
    return d.orderBy(F.desc("bend"), "k").limit(1)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding")


def _ivf_recall(s: SparkSession, d: str) -> DataFrame:
    """probes, recall as far as they were needed."""
    e = _vectors(s, d)
    return s.createDataFrame(tune_probes(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding")[1], "probes int, recall double")


QUERIES = {
    "vector_norms": lambda s, d: _vectors(s, d).select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("dimension")),
    "vector_search": lambda s, d: _hits(s, d).select("query_id", F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim")),
    "label_centroids": lambda s, d: label_centroids(_vectors(s, d), "embedding", "label"),
    "threshold_grid": lambda s, d: threshold_grid(_hits(s, d), _vectors(s, d), "vec_id", "label"),
    "ivf_recall": _ivf_recall,
    "vector_cells": lambda s, d: ivf_index(_vectors(s, d), "vec_id", "embedding")[0].groupBy("cell").agg(F.count(F.lit(1)).alias("size")),
}

_HITS = """hits AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS sim, q.label AS ql, r.label AS hl
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings r ON q.vec_id <> r.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY sim DESC, r.vec_id) <= 10)"""
SQL = {
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, len(embedding)::INTEGER AS dimension FROM embeddings",
    "vector_search": f"WITH {_HITS} SELECT query_id, id AS vec_id, round(sim, 4) AS sim FROM hits",
    "label_centroids": """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m, avg(x * x) AS q, count(*) AS n FROM p GROUP BY ALL)
SELECT label, max(n) AS size, round(sqrt(sum(m * m)), 6) AS centroid_norm, round(sum(q - m * m), 6) AS spread FROM m GROUP BY label""",
    "threshold_grid": f"""WITH {_HITS}, g AS (SELECT t / 10.0::DOUBLE AS threshold, ql, hl FROM hits, range(1, 10) r(t) WHERE sim >= t / 10.0::DOUBLE)
SELECT threshold, count(*) AS kept, count(*) FILTER (WHERE ql = hl) AS right, round(count(*) FILTER (WHERE ql = hl) / count(*), 6)::DOUBLE AS precision FROM g GROUP BY threshold""",
}
