"""Scores of reasoning paths: relations, nodes, coherence, reasoning value; diverse selections; what paths give their nodes.

Paths come from `graph.simple_paths` on the undirected graph, a bounded number per seed; their edges, nodes and
pairs of nodes are exploded and joined with the graph, never the other way round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import sqlkit as sk
from noteflow.functions import text as tx
from noteflow.functions.runtime import stage
from noteflow.operators import graph
from noteflow.operators.graph import relations
from noteflow.operators.notes import notes

# How much a relation's type counts on a path, and how much it helps to reason.
TYPE_WEIGHTS = {
    "causal": 1.0, "definition": 0.95, "reference": 0.9, "temporal": 0.85, "instance_of": 0.8, "part_of": 0.8, "comparison": 0.75, "entity_coexistence": 0.7, "support": 0.7,
    "topic_relation": 0.6, "context_relation": 0.5, "semantic_similarity": 0.4, "contradiction": 0.3,
}
REASONING = {"causal": 1.0, "temporal": 0.8, "definition": 0.7, "semantic_similarity": 0.6, "context": 0.5, "reference": 0.4, "entity_coexistence": 0.3}
PARTS = {"length": 0.15, "relation": 0.25, "node": 0.25, "coherence": 0.20, "reasoning": 0.15}
#: The least score of a path, the share of it that counts where fewer than FEW paths reach it, and the least diversity.
LEAST, RELAXED, FEW, DIVERSE = 0.3, 0.7, 3, 0.7


def simple_graph(r: DataFrame) -> DataFrame:
    """a, b, weight, kind: one undirected edge per pair of notes, the heaviest relation between them, ties by its type; a < b."""
    ends = r.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "weight", "relation_type")
    return ends.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.min_by("relation_type", F.struct(-F.col("weight"), F.col("relation_type"))).alias("kind"))


def seed_paths(g: DataFrame, seeds: DataFrame, most_hops: int = 2, most_paths: int = 10) -> DataFrame:
    """path_id, seed, path: the first paths of each seed; a path and its reverse have one path_id."""
    e = g.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    p = graph.simple_paths(e.union(g.select("b", "a", "weight")), seeds, most_hops, most_paths)
    return p.select(F.least(F.array_join("path", ">"), F.array_join(F.reverse("path"), ">")).alias("path_id"), "seed", "path")


def path_rows(p: DataFrame) -> DataFrame:
    """path_id, seed, path, seeds, row of `seed_paths`; a path and its reverse are one (the first by seed stays); seeds: its one or
    two; row: a short number for it."""
    x = p.groupBy("path_id").agg(F.min(F.struct("seed", "path")).alias("x"), F.array_distinct(F.array(F.min("seed"), F.max("seed"))).alias("seeds"))
    return stage(x.select("path_id", "x.seed", "x.path", "seeds", F.monotonically_increasing_id().alias("row")), "path-rows")


def _pairs(p: DataFrame, g: DataFrame) -> DataFrame:
    """path_id, i, j (places in the path, i < j), weight, kind: the edges among the nodes of each path."""
    rows = p.select("path_id", F.posexplode("path").alias("i", "u"), "path").select("path_id", "i", "u", F.posexplode("path").alias("j", "v")).where("i < j")
    rows = rows.select("path_id", "i", "j", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return stage(rows.join(g, ["a", "b"]).select("path_id", "i", "j", "weight", "kind"), "path-edges")


def path_scores(p: DataFrame, g: DataFrame, n: DataFrame, centrality: DataFrame) -> DataFrame:
    """path_id, seed, n_nodes, relation, node, coherence, reasoning, score of each path.

    relation: mean of type weight times weight; node: mean of 0.3 centrality + 0.3 importance (0.5 if unknown); coherence: mean
    of the mean weight among each three successive nodes, the share of topics (titles) all nodes have, and the mean
    likeness of keywords over pairs; reasoning: mean value of the types; score: weighted, with one over the number of
    nodes. n: note_id, importance_score, title, keywords. centrality: node, centrality."""
    pairs = _pairs(p, g)
    value = lambda table: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("kind")], F.lit(0.5))
    steps = pairs.where("j = i + 1").groupBy("path_id").agg(F.avg(value(TYPE_WEIGHTS) * F.col("weight")).alias("relation"), F.avg(value(REASONING)).alias("reasoning"))
    triples = pairs.where("j - i <= 2").select("path_id", "weight", F.explode(F.when(F.col("j") - F.col("i") == 2, F.array("i")).otherwise(F.array(F.col("i") - 1, F.col("i")))).alias("t"))
    last = p.select("path_id", (F.size("path") - 3).alias("last"))
    triples = triples.join(last, "path_id").where("t >= 0 AND t <= last").groupBy("path_id", "t").agg(F.avg("weight").alias("w")).groupBy("path_id").agg(F.sum("w").alias("triples"))
    words = F.array_distinct(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull()))
    own = n.select(F.col("note_id").alias("node"), F.coalesce("importance_score", F.lit(0.5)).alias("importance"), F.when(~tx.blank(F.col("title")), F.array("title")).otherwise(F.array().cast("array<string>")).alias("topics"), words.alias("words"))
    nodes = p.select("path_id", F.posexplode("path").alias("i", "node")).join(own, "node", "left").join(centrality, "node", "left")
    empty = F.array().cast("array<string>")
    nodes = nodes.groupBy("path_id").agg(
        F.avg(0.3 * F.coalesce("centrality", F.lit(0.0)) + 0.3 * F.coalesce("importance", F.lit(0.5))).alias("node"),
        F.collect_list(F.coalesce("topics", empty)).alias("topics"), F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("words", empty).alias("w")))), lambda x: x["w"]).alias("words"),
    )
    common = F.aggregate(F.slice("topics", 2, F.size("topics")), F.col("topics")[0], lambda a, b: F.array_intersect(a, b))
    topic = F.when(F.size(F.array_distinct(F.flatten("topics"))) > 0, F.size(common) / F.size(F.array_distinct(F.flatten("topics")))).otherwise(0.0)
    likeness = F.flatten(F.transform("words", lambda a, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda b: tx.jaccard(a, b))))
    overlap = F.aggregate(likeness, F.lit(0.0), lambda s, x: s + x) / F.size(likeness)
    j = p.select("path_id", "seed", F.size("path").alias("n_nodes")).join(steps, "path_id").join(nodes, "path_id").join(triples, "path_id", "left")
    threes = F.greatest(F.lit(0), F.col("n_nodes") - 2)
    coherence = (F.coalesce("triples", F.lit(0.0)) + topic + overlap) / (threes + 2)
    j = j.select("path_id", "seed", "n_nodes", *[tx.rounded(c, 6).alias(k) for k, c in (("relation", F.col("relation")), ("node", F.col("node")), ("coherence", coherence), ("reasoning", F.col("reasoning")))])
    score = sum((F.col(k) * w for k, w in PARTS.items() if k != "length"), PARTS["length"] / F.col("n_nodes"))
    return j.withColumn("score", tx.rounded(score, 6))


def scored_paths(s: DataFrame) -> DataFrame:
    """The paths of each seed that score LEAST; where fewer than FEW do, those that score RELAXED times as much."""
    enough = F.count_if(F.col("score") >= LEAST).over(Window.partitionBy("seed")) >= FEW
    return s.withColumn("enough", enough).where(F.col("score") >= F.when(F.col("enough"), LEAST).otherwise(LEAST * RELAXED)).drop("enough")


def diverse_paths(s: DataFrame, most: int = 10) -> DataFrame:
    """seed, path_id, place, score: per seed the best path, then each that shares no more than 1 - DIVERSE of its nodes (Jaccard)
    with every chosen one, `most` at most; ties by path. A seed has few paths."""
    row = F.struct((-F.col("score")).alias("down"), "path_id", F.array_distinct(F.split("path_id", ">")).alias("nodes"))
    best = s.groupBy("seed").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    far = lambda x, y: 1 - F.size(F.array_intersect(x["nodes"], y["nodes"])) / F.size(F.array_union(x["nodes"], y["nodes"])) >= DIVERSE
    add = lambda chosen, x: F.when((F.size(chosen) < most) & F.forall(chosen, lambda y: far(x, y)), F.array_append(chosen, x)).otherwise(chosen)
    chosen = best.select("seed", F.posexplode(F.aggregate("rows", F.slice("rows", 1, 0), add)).alias("place", "x"))
    return chosen.select("seed", "x.path_id", (F.col("place") + 1).alias("place"), (-F.col("x.down")).alias("score"))


def penalized_paths(s: DataFrame, pick: int = 4, overlap: float = 0.5) -> DataFrame:
    """seed, path_id, place: per seed the path with the largest score, then again and again the one with the largest score after
    its largest overlap (Jaccard of nodes) with a chosen one is taken off, if that is over `overlap`; `pick` paths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "path_id"], ascending=[False, True], ignore_index=True)
        sets, chosen, left = [set(x.split(">")) for x in pdf.path_id], [], list(range(len(pdf)))
        while left and len(chosen) < pick:
            worst = lambda i: max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in chosen), default=0.0)
            best = max(left, key=lambda i: (round(pdf.score[i] * (1 - (worst(i) if worst(i) > overlap else 0.0)), 9), -i))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"seed": pdf.seed.iloc[chosen].values, "path_id": pdf.path_id.iloc[chosen].values, "place": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return s.select("seed", "path_id", "score").groupBy("seed").applyInPandas(run, "seed string, path_id string, place int")


def node_scores(s: DataFrame) -> DataFrame:
    """node, score, n_paths, share: sum over the paths of score / (place from 1), how many paths hold the node and which share
    of all."""
    total = s.agg(F.count(F.lit(1)).alias("total"))
    rows = s.select("score", F.posexplode(F.split("path_id", ">")).alias("i", "node"))
    out = rows.groupBy("node").agg(F.sum(F.col("score") / (F.col("i") + 1)).alias("s"), F.count(F.lit(1)).alias("n_paths")).crossJoin(F.broadcast(total))
    return out.select("node", tx.rounded(F.col("s"), 8).alias("score"), "n_paths", tx.rounded(F.col("n_paths") / F.col("total"), 6).alias("share"))


def context_scores(p: DataFrame, g: DataFrame, ends: DataFrame, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2, rho: float = 0.25, decay: float = 0.05) -> DataFrame:
    """path_id, score: alpha times the similarity of the end to the seed (0 if unknown) + beta times the mean weight (between
    0.01 and 1) + gamma times nodes / 5, `rho` at most, - decay per node beyond three, not under 0. ends: seed, node, sim."""
    mean = _pairs(p, g).where("j = i + 1").groupBy("path_id").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.01), "weight"))).alias("mean"))
    j = p.withColumn("node", F.element_at("path", -1)).join(mean, "path_id").join(ends, ["seed", "node"], "left")
    n = F.size("path")
    score = alpha * F.coalesce("sim", F.lit(0.0)) + beta * F.col("mean") + gamma * F.least(F.least(n / 5, F.lit(1.0)), F.lit(rho)) - decay * F.greatest(F.lit(0), n - 3)
    return j.select("path_id", "seed", F.round(F.greatest(F.lit(0.0), score), 6).alias("score"))


def mode_parameters(mode: str = "auto", alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2, rho: float = 0.25) -> dict[str, float]:
    """The weights of `context_scores` for precise and explanatory questions, within bounds; any other mode leaves them."""
    if mode == "precise":
        return {"alpha": min(0.7, alpha * 1.4), "beta": max(0.1, beta * 0.7), "gamma": max(0.1, gamma * 0.7), "rho": max(0.15, rho * 0.6)}
    if mode == "explanatory":
        return {"alpha": max(0.2, alpha * 0.6), "beta": min(0.5, beta * 1.5), "gamma": min(0.4, gamma * 1.5), "rho": min(0.4, rho * 1.6)}
    return {"alpha": alpha, "beta": beta, "gamma": gamma, "rho": rho}


def degree_limited(r: DataFrame, most: int = 10) -> DataFrame:
    """relation_id, place: relations from the heaviest on as long as neither end has its fill, which is `most` and one more for
    each ten of the summed weight of its relations, twice `most` at most. r has few rows (`graph.cap_by_type` bounds them by the
    caps of the types), so one task decides in order."""
    ends = r.select(F.explode(F.array("source_id", "target_id")).alias("node"), "weight").groupBy("node").agg(F.least(F.lit(2 * most), most + F.floor(F.sum("weight") / 10)).cast("int").alias("fill"))
    j = r.join(ends.toDF("source_id", "fill_a"), "source_id").join(ends.toDF("target_id", "fill_b"), "target_id").select("relation_id", "source_id", "target_id", "weight", "fill_a", "fill_b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        kept = []
        for x in pdf.sort_values(["weight", "relation_id"], ascending=[False, True]).itertuples():
            if used.get(x.source_id, 0) < x.fill_a and used.get(x.target_id, 0) < x.fill_b:
                kept.append(x.relation_id)
                used[x.source_id] = used.get(x.source_id, 0) + 1
                used[x.target_id] = used.get(x.target_id, 0) + 1
        return pd.DataFrame({"relation_id": pd.Series(kept, dtype=object), "place": np.arange(1, len(kept) + 1, dtype=np.int32)})

    return j.groupBy(F.lit(0).alias("all")).applyInPandas(run, "relation_id string, place int")


def _nodes(g: DataFrame) -> DataFrame:
    return g.select(F.col("a").alias("node")).union(g.select("b")).distinct()


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = stage(simple_graph(relations(s, d)), "simple-graph")
    seeds = _nodes(g).where(F.regexp_extract("node", r"^note_[a-z]+_(\d+)_", 1).try_cast("int") % 50 == 0)
    return g, path_rows(seed_paths(g, stage(seeds, "seeds")))


def _scored(s: SparkSession, d: str, g: DataFrame, p: DataFrame) -> DataFrame:
    ends = g.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    n = ends.agg(F.count(F.lit(1)).alias("n"))
    centrality = ends.crossJoin(F.broadcast(n)).select("node", (F.col("k") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))
    return stage(path_scores(p, g, notes(s, d).select("note_id", "importance_score", "title", "keywords"), centrality), "path-scores")


def _scores(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d, *_graph(s, d))


def _diverse(s: SparkSession, d: str) -> DataFrame:
    """Every node of the graph is a seed and chooses among all of its own paths, also those another seed has in reverse.
    Scores are looked up by the row of a path, as names of paths are long."""
    g = stage(simple_graph(relations(s, d)), "simple-graph")
    p = path_rows(seed_paths(g, stage(_nodes(g), "seeds")))
    scores = _scored(s, d, g, p.select(F.col("row").alias("path_id"), "seed", "path")).select(F.col("path_id").alias("row"), "score")
    return diverse_paths(scored_paths(p.join(scores, "row").select("path_id", F.explode("seeds").alias("seed"), "score")))


def _context(s: SparkSession, d: str) -> DataFrame:
    g, p = _graph(s, d)
    none = p.select("seed", F.element_at("path", -1).alias("node"), F.lit(0.0).alias("sim")).limit(0)
    return context_scores(p, g, none)


def _limited(s: SparkSession, d: str) -> DataFrame:
    r = graph.merge_relations(relations(s, d)).withColumn("relation_id", F.concat_ws("|", "source_id", "target_id", "relation_type"))
    return degree_limited(graph.cap_by_type(r))


QUERIES = {
    "simple_graph": lambda s, d: simple_graph(relations(s, d)),
    "path_scores": _scores,
    "paths_over_threshold": lambda s, d: scored_paths(_scores(s, d)).select("path_id", "seed", "score"),
    "paths_diverse": _diverse,
    "paths_penalized": lambda s, d: penalized_paths(_scores(s, d)),
    "path_node_scores": lambda s, d: node_scores(_scores(s, d)),
    "path_context_scores": _context,
    "relations_degree_limited": _limited,
}

_CASE = lambda t: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE 0.5 END::DOUBLE"
_BASE = f"""WITH {sk.RELATIONS}, {sk.NOTES}, g AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(weight) AS weight, arg_min(relation_type, (-weight, relation_type)) AS kind FROM rel GROUP BY 1, 2),
u AS (SELECT a AS src, b AS dst, weight FROM g UNION ALL SELECT b, a, weight FROM g), t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS turn FROM u),
seeds AS (SELECT DISTINCT src AS node FROM u WHERE try_cast(regexp_extract(src, '^note_[a-z]+_(\\d+)_', 1) AS INTEGER) % 50 = 0),
k1 AS (SELECT node AS seed, [node, dst] AS path, [turn] AS turns, row_number() OVER (PARTITION BY node ORDER BY turn) AS place FROM seeds JOIN t ON node = src QUALIFY place <= 10), n1 AS (SELECT seed, count(*) AS n FROM k1 GROUP BY seed),
k2 AS (SELECT seed, list_append(path, dst) AS path, list_append(turns, turn) AS turns, n + row_number() OVER (PARTITION BY seed ORDER BY list_append(turns, turn)) AS place2 FROM k1 JOIN t ON path[-1] = src JOIN n1 USING (seed) WHERE NOT list_contains(path, dst) QUALIFY place2 <= 10),
p0 AS (SELECT seed, path, least(array_to_string(path, '>'), array_to_string(list_reverse(path), '>')) AS path_id FROM (SELECT seed, path FROM k1 UNION ALL SELECT seed, path FROM k2)), p AS (SELECT path_id, min(seed) AS seed, arg_min(path, (seed, path)) AS path FROM p0 GROUP BY path_id),
pi AS (SELECT path_id, path, unnest(range(1, len(path) + 1)) AS i FROM p), ij AS (SELECT path_id, i, j, least(path[i], path[j]) AS a, greatest(path[i], path[j]) AS b FROM (SELECT *, unnest(range(i + 1, len(path) + 1)) AS j FROM pi)),
e AS (SELECT path_id, i, j, weight, kind FROM ij JOIN g USING (a, b))"""
_NJ = sk.jaccard("x.w", "y.w")
_SC = f"""{_BASE}, st AS (SELECT path_id, avg({_CASE(TYPE_WEIGHTS)} * weight) AS relation, avg({_CASE(REASONING)}) AS reasoning FROM e WHERE j = i + 1 GROUP BY path_id),
tr AS (SELECT e1.path_id, pi.i, avg(e1.weight) AS w FROM pi JOIN e e1 ON e1.path_id = pi.path_id AND e1.i >= pi.i AND e1.j <= pi.i + 2 WHERE pi.i + 2 <= len(path) GROUP BY ALL), ts AS (SELECT path_id, sum(w) AS triples FROM tr GROUP BY path_id),
dg AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g) GROUP BY node), ce AS (SELECT node, k / greatest((SELECT count(*) FROM dg) - 1, 1)::DOUBLE AS centrality FROM dg),
nd AS (SELECT pi.path_id, pi.i, coalesce(importance_score, 0.5) AS imp, coalesce(centrality, 0.0) AS c, CASE WHEN note_id IS NOT NULL AND NOT {sk.BLANK.format('title')} THEN [title] ELSE []::VARCHAR[] END AS tp, list_distinct(list_filter(coalesce(keywords, []::VARCHAR[]), lambda k: k IS NOT NULL)) AS w
  FROM pi LEFT JOIN notes ON note_id = path[i] LEFT JOIN ce ON ce.node = path[i]),
na AS (SELECT path_id, avg(0.3::DOUBLE * c + 0.3::DOUBLE * imp) AS node, count(*) AS n, len(list_distinct(flatten(list(tp)))) AS every, min(len(tp)) AS least FROM nd GROUP BY path_id),
ov AS (SELECT x.path_id, avg({_NJ}) AS overlap FROM nd x JOIN nd y ON x.path_id = y.path_id AND x.i < y.i GROUP BY x.path_id),
f AS (SELECT p.path_id, p.seed, len(path)::INTEGER AS n_nodes, round(relation, 6) AS relation, round(node, 6) AS node, round((coalesce(triples, 0.0) + CASE WHEN every = 1 AND least = 1 THEN 1.0 ELSE 0.0 END + overlap) / (greatest(0, len(path) - 2) + 2), 6) AS coherence, round(reasoning, 6) AS reasoning
  FROM p JOIN st USING (path_id) JOIN na USING (path_id) JOIN ov USING (path_id) LEFT JOIN ts USING (path_id)),
sc AS (SELECT *, round(0.15::DOUBLE / n_nodes + 0.25::DOUBLE * relation + 0.25::DOUBLE * node + 0.20::DOUBLE * coherence + 0.15::DOUBLE * reasoning, 6) AS score FROM f)"""

SQL = {
    "simple_graph": f"{_BASE} SELECT * FROM g",
    "path_scores": f"{_SC} SELECT * FROM sc",
    "paths_over_threshold": f"{_SC}, c AS (SELECT *, count(*) FILTER (WHERE score >= 0.3) OVER (PARTITION BY seed) AS n FROM sc) SELECT path_id, seed, score FROM c WHERE score >= CASE WHEN n >= 3 THEN 0.3::DOUBLE ELSE 0.3::DOUBLE * 0.7::DOUBLE END",
    "path_node_scores": f"{_SC}, r AS (SELECT score, string_split(path_id, '>') AS ns, unnest(range(1, n_nodes + 1)) AS i FROM sc) SELECT ns[i] AS node, round(sum(score / i), 8) AS score, count(*) AS n_paths, round(count(*) / (SELECT count(*) FROM sc)::DOUBLE, 6) AS share FROM r GROUP BY 1",
    "path_context_scores": f"""{_BASE}, m AS (SELECT path_id, avg(least(1.0, greatest(0.01, weight))) AS mean FROM e WHERE j = i + 1 GROUP BY path_id)
SELECT path_id, seed, round(greatest(0.0, 0.3::DOUBLE * mean + 0.2::DOUBLE * least(least(len(path) / 5.0::DOUBLE, 1.0), 0.25::DOUBLE) - 0.05::DOUBLE * greatest(0, len(path) - 3)), 6)::DOUBLE AS score FROM p JOIN m USING (path_id)""",
}
