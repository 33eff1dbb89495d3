"""Operators on the graph of note relations: cleaning, statistics, audit, neighbourhoods, paths, centrality, components.

Every traversal is a loop of equi-joins on edge tables that are combined before they are shuffled; each step is staged
in the shared folder, so plans stay short and survive lost executors.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions.runtime import stage, table
from noteflow.operators.notes import SQL_NOTES, notes
from noteflow.operators.references import latest

# How many relations of a type are kept, and how much a type helps to reason.
TYPE_CAPS = {"reference": 100, "entity_coexistence": 60, "context_relation": 40, "topic_relation": 30, "semantic_similarity": 50, "personal_relation": 80}
OTHER_CAP = 25
REASONING = {
    "reference": 0.4, "entity_coexistence": 0.3, "context": 0.5, "topic": 0.4, "semantic_similarity": 0.6, "personal": 0.3, "causal": 1.0, "temporal": 0.8, "definition": 0.7,
    "comparison": 0.6, "elaboration": 0.5, "contradiction": 0.9, "succession": 0.9, "acquisition": 0.95, "ownership": 0.8, "subsidiary": 0.7, "partnership": 0.6, "merger": 0.95,
}
UNDIRECTED = ["entity_coexistence", "semantic_similarity", "topic_relation", "personal_relation"]


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_relations, each once, types in lower case, without null ends or loops; a null weight counts as 0."""
    r = latest(table(spark, sf_dir, "note_relations"), ["relation_id"])
    r = r.withColumn("relation_type", F.lower("relation_type")).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return r.where("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id != target_id")


SQL_RELATIONS = """rel AS (SELECT relation_id, source_id, target_id, lower(relation_type) AS relation_type, coalesce(weight, 0.0) AS weight, reasoning_value, metadata, extracted_at
  FROM (SELECT * FROM note_relations QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY ingested_at DESC NULLS LAST) = 1)
  WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id)"""


def merge_relations(r: DataFrame) -> DataFrame:
    """source_id, target_id, relation_type, weight, n: one relation per pair and type, the largest weight; types of
    UNDIRECTED do not tell the directions apart."""
    both = F.col("relation_type").isin(UNDIRECTED) & (F.col("source_id") > F.col("target_id"))
    return (
        r.withColumn("a", F.when(both, F.col("target_id")).otherwise(F.col("source_id"))).withColumn("b", F.when(both, F.col("source_id")).otherwise(F.col("target_id")))
        .groupBy(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "relation_type").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    )


def edges(r: DataFrame) -> DataFrame:
    """src, dst, weight: one directed edge per ordered pair, the largest weight."""
    return r.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max("weight").alias("weight"))


def undirected(e: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once."""
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def cap_by_type(r: DataFrame) -> DataFrame:
    """The heaviest relations of each type, up to its cap (a report of the top, ties by relation_id)."""
    cap = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_CAPS.items() for x in kv])[F.col("relation_type")], F.lit(OTHER_CAP))
    w = Window.partitionBy("relation_type").orderBy(F.desc("weight"), "relation_id")
    # the largest cap bounds the window before it is shuffled
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(*TYPE_CAPS.values(), OTHER_CAP)).where(F.col("place") <= cap)


def relation_statistics(r: DataFrame) -> DataFrame:
    """Per type: count, mean, deviation, least and largest weight."""
    return r.groupBy("relation_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.round(F.stddev_pop("weight"), 6).alias("std_weight"),
        F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
    )


def reasoning_values(r: DataFrame) -> DataFrame:
    """The reasoning value of the relation's type, 0.5 for other types; a stored value is replaced."""
    by_type = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONING.items() for x in kv])[F.col("relation_type")], F.lit(0.5))
    return r.select("relation_id", by_type.alias("reasoning"))


def degrees(e: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, total_weight."""
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "weight").unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "weight"))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.round(F.sum("weight"), 6).alias("total_weight"))


def audit(n: DataFrame, r: DataFrame) -> DataFrame:
    """One row: notes, edges, dangling edges (an end is no note), isolated notes, their share and whether it is over 0.3."""
    ids = n.select(F.col("note_id").alias("node"))
    ends = r.select("relation_id", F.explode(F.array(F.struct(F.col("source_id").alias("node")), F.struct(F.col("target_id").alias("node")))).alias("x")).select("relation_id", "x.node")
    dangling = ends.join(ids, "node", "left_anti").agg(F.count_distinct("relation_id").alias("dangling"))
    isolated = ids.join(ends.select("node").distinct(), "node", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    totals = n.agg(F.count(F.lit(1)).alias("notes")).crossJoin(r.agg(F.count(F.lit(1)).alias("edges")))
    out = totals.crossJoin(dangling).crossJoin(isolated)  # four tables of one row
    share = F.when(F.col("notes") > 0, F.col("isolated") / F.col("notes")).otherwise(F.lit(0.0))
    return out.withColumn("isolated_ratio", F.round(share, 6)).withColumn("too_isolated", F.col("isolated_ratio") > 0.3)


def two_hop(e: DataFrame, least: float = 0.1) -> DataFrame:
    """src, dst, weight: derived edges over one node in between, the best product of weights times 0.5 over `least`,
    where no direct edge joins the two in either direction. Edges too light for any partner are dropped before the
    join, which follows from the heaviest edge."""
    top = e.agg(F.max("weight").alias("top"))
    e = stage(e.crossJoin(F.broadcast(top)).where(F.col("weight") * F.col("top") * 0.5 > least).drop("top"), "heavy-edges")
    a = e.select("src", F.col("dst").alias("mid"), F.col("weight").alias("w1"))
    b = e.select(F.col("src").alias("mid"), "dst", F.col("weight").alias("w2"))
    found = a.join(b, "mid").where((F.col("w1") * F.col("w2") * 0.5 > least) & (F.col("src") != F.col("dst")))
    return found.groupBy("src", "dst").agg(F.max(F.round(F.col("w1") * F.col("w2") * 0.5, 8)).alias("weight"))


def without_direct(derived: DataFrame, e: DataFrame) -> DataFrame:
    """Derived edges between nodes that no edge joins."""
    return derived.join(undirected(e).select("src", "dst"), ["src", "dst"], "left_anti")


def hops(e: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """node, distance: nodes within k steps of any seed along edges, the least number of steps."""
    found = stage(seeds.select("node").distinct().withColumn("distance", F.lit(0)), "hops")
    front = found.select("node")
    for step in range(1, k + 1):
        reached = e.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        new = stage(reached.join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(step)), "hops")
        if new.isEmpty():
            break
        found, front = found.unionByName(new), new.select("node")
    return found


def strongest_neighbours(e: DataFrame, k: int = 8) -> DataFrame:
    """src, dst, weight, place: the k heaviest edges of each node."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def simple_paths(e: DataFrame, seeds: DataFrame, most_hops: int = 3, most_paths: int = 10) -> DataFrame:
    """seed, path, hops, score: the first `most_paths` paths of each seed that visit no node twice, in breadth-first order
    with the heaviest edges first, ties by node; the score is the product of weights over 1 + hops. e: each ordered pair once."""
    # of a node's branches a path can lose those to its own nodes, most_hops at most; the first most_paths others are among these
    first = most_paths + most_hops
    e = e.withColumn("turn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where(F.col("turn") <= first)
    fans = e.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).cast("int").alias("fan"))
    e = stage(e.join(fans, "dst", "left").select("src", "dst", "weight", "turn", F.coalesce("fan", F.lit(0)).alias("fan")), "branches")
    w = Window.partitionBy("seed")
    paths = seeds.select(F.col("node").alias("seed"), F.array("node").alias("path"), F.lit(0).alias("place"), F.lit(1.0).alias("product"), F.lit(0).alias("done"), F.lit(most_paths).alias("left"))
    out = None
    for step in range(1, most_hops + 1):
        if out is not None:  # a path with `fan` branches goes on to all but its own nodes at least: later ones only count for what is left
            sure = F.sum(F.greatest(F.col("fan") - F.size("path"), F.lit(0))).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
            paths = paths.withColumn("done", F.max("place").over(w)).withColumn("left", most_paths - F.col("done") - F.coalesce(sure, F.lit(0))).where("left > 0 AND fan > 0").drop("fan")
        ahead = paths.withColumn("src", F.element_at("path", -1)).join(e, "src").where((F.col("turn") <= F.col("left") + F.size("path")) & ~F.array_contains("path", F.col("dst")))
        ahead = ahead.withColumn("next", F.row_number().over(w.orderBy("place", "turn"))).where(F.col("next") <= most_paths)
        ahead = ahead.select("seed", F.array_append("path", F.col("dst")).alias("path"), (F.col("done") + F.col("next")).alias("place"), F.lit(step).alias("hops"), (F.col("product") * F.col("weight")).alias("product"), "fan")
        paths = stage(ahead.where(F.col("place") <= most_paths), "paths")
        out = paths if out is None else out.unionByName(paths)
    return out.select("seed", "path", "hops", F.round(F.col("product") / (1 + F.col("hops")), 6).alias("score"))


def pagerank(e: DataFrame, rounds: int | None = 10, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """node, rank: weighted PageRank after `rounds` rounds; ranks sum to 1. Dangling nodes share theirs with all. With
    rounds None: until the summed change is under `tolerance` a node and 1e-4 in all, so large graphs are not cut short."""
    nodes = stage(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(1.0))
    total = e.groupBy("src").agg(F.sum("weight").alias("total")).where("total > 0")
    shares = stage(e.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    senders = stage(shares.select(F.col("src").alias("node")).distinct(), "senders")
    ranks = stage(nodes.withColumn("rank", F.lit(1.0 / n)), "ranks")
    for _ in itertools.count() if rounds is None else range(rounds):
        lost = ranks.join(senders, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = shares.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(got, "node", "left").crossJoin(F.broadcast(lost))
        rank = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        new = stage(new.select("node", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change")), "ranks")
        ranks = new.select("node", "rank")
        if rounds is None and new.agg(F.sum("change")).first()[0] < min(n * tolerance, 1e-4):
            break
    return ranks


def components(e: DataFrame) -> DataFrame:
    """node, component (its smallest node): alternating large-star and small-star steps, so the number of rounds grows
    with the logarithm of the longest path and no component is gathered in one task."""
    pairs = stage(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct(), "pairs")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    before = None
    while True:
        near = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u != v").distinct()
        pairs = stage(small, "small-star")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def linear_fusion(r: DataFrame, dense: str = "semantic_similarity", sparse: str = "reference", graph: str = "entity_coexistence", weights=(0.5, 0.3, 0.2)) -> DataFrame:
    """query, candidate, score: per query, weights of three kinds of relation divided by the query's largest of that
    kind, added with `weights`; candidates of none of the kinds do not come out."""
    kinds = {dense: weights[0], sparse: weights[1], graph: weights[2]}
    rows = r.where(F.col("relation_type").isin(*kinds)).groupBy(F.col("source_id").alias("query"), F.col("target_id").alias("candidate"), "relation_type").agg(F.max("weight").alias("s"))
    top = rows.groupBy("query", "relation_type").agg(F.max("s").alias("top"))
    scaled = rows.join(top, ["query", "relation_type"]).withColumn("scaled", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(F.lit(0.0)))
    weight = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("relation_type")]
    return scaled.groupBy("query", "candidate").agg(F.round(F.sum(F.col("scaled") * weight), 6).alias("score"))


def rank_fusion(r: DataFrame, k: int = 50, pool: int = 80) -> DataFrame:
    """query, candidate, score: sum of 1 / (k + rank) over the kinds of relation, rank by weight, ties by candidate;
    all candidates of each kind take part, the best `pool` fused ones of a query come out."""
    rows = r.groupBy(F.col("source_id").alias("query"), F.col("target_id").alias("candidate"), "relation_type").agg(F.max("weight").alias("s"))
    w = Window.partitionBy("query", "relation_type").orderBy(F.desc("s"), "candidate")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    fused = ranked.groupBy("query", "candidate").agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return fused.withColumn("place", F.row_number().over(best)).where(F.col("place") <= pool).drop("place")


def merged_evidence(r: DataFrame) -> DataFrame:
    """target_id, hits, sources (sorted types), best_source, score = 0.6 best weight + 0.3 hits / 5 + 0.1 types / 2, each
    share at most 1: what several retrievals found, one row per note."""
    g = r.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("hits"), F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("sources"), F.count_distinct("relation_type").alias("kinds"),
        F.max(F.struct("weight", "source_id")).alias("m"),
    )
    score = 0.6 * F.col("m.weight") + 0.3 * F.least(F.col("hits") / 5, F.lit(1.0)) + 0.1 * F.least(F.col("kinds") / 2, F.lit(1.0))
    return g.select("target_id", "hits", "sources", F.col("m.source_id").alias("best_source"), F.round(score, 6).alias("score"))


def zscore_blend(r: DataFrame, share: float = 0.65) -> DataFrame:
    """relation_id, score: z-scores of weight and reasoning value within the relation type (population deviation, 0 where
    it is 0), blended. Types may be hot: their moments are aggregated first and joined back by broadcast (one row per
    type)."""
    v = r.where("reasoning_value IS NOT NULL")
    m = v.groupBy("relation_type").agg(*[f(c).alias(f"{n}_{c}") for c in ("weight", "reasoning_value") for n, f in (("avg", F.avg), ("std", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"std_{c}") > 1e-9, (F.col(c) - F.col(f"avg_{c}")) / F.col(f"std_{c}")).otherwise(F.lit(0.0))
    return v.join(m, "relation_type").select("relation_id", F.round((1 - share) * z("weight") + share * z("reasoning_value"), 5).alias("score"))


def best_entity(n: DataFrame, r: DataFrame) -> DataFrame:
    """query, entity, score, n_notes: the entity with the largest sum of weights over a note's neighbours, times
    1 + 0.03 for each further note (at most 3); entities of the note itself are left out; ties by entity."""
    held = stage(n.select("note_id", F.explode(F.array_distinct(F.filter("entities", lambda e: F.trim(e) != ""))).alias("entity")), "held")
    one = r.groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    found = one.join(held.withColumnRenamed("note_id", "target_id"), "target_id")
    found = found.groupBy(F.col("source_id").alias("query"), "entity").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n_notes"))
    found = found.join(held.select(F.col("note_id").alias("query"), "entity"), ["query", "entity"], "left_anti")
    score = F.round(F.col("s") * (1 + 0.03 * F.least(F.col("n_notes") - 1, F.lit(3))), 6)
    best = found.withColumn("score", score).withColumn("p", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entity")))
    return best.where("p = 1").select("query", "entity", "score", "n_notes")


def _seeds(e: DataFrame) -> DataFrame:
    """A query set: nodes whose file number is divisible by 50."""
    return e.select(F.col("src").alias("node")).distinct().where(F.regexp_extract("node", r"^note_[a-z]+_(\d+)_", 1).try_cast("int") % 50 == 0)


def _r(make):
    return lambda s, d: make(relations(s, d))


def _e(make):
    return lambda s, d: make(stage(edges(relations(s, d)), "edges"))


QUERIES = {
    "relation_dedup": _r(merge_relations),
    "relation_statistics": _r(relation_statistics),
    "relation_top_by_type": _r(lambda r: cap_by_type(r).select("relation_type", "relation_id", "place")),
    "relation_reasoning": _r(reasoning_values),
    "node_degrees": _e(degrees),
    "graph_audit": lambda s, d: audit(notes(s, d), relations(s, d)),
    "two_hop_relations": _e(lambda e: without_direct(two_hop(e), e)),
    "neighbourhood": _e(lambda e: hops(undirected(e.where("weight >= 0.35")), _seeds(e), 2)),
    "strongest_neighbours": _e(strongest_neighbours),
    "reasoning_paths": _e(lambda e: simple_paths(e, _seeds(e)).select("seed", F.array_join("path", ">").alias("path"), "hops", "score")),
    "note_pagerank": _e(lambda e: pagerank(undirected(e), None).select("node", F.round("rank", 9).alias("rank"))),
    "note_components": _e(components),
    "fusion_linear": _r(linear_fusion),
    "fusion_rank": _r(rank_fusion),
    "evidence_merge": _r(merged_evidence),
    "zscore_blend": _r(zscore_blend),
    "best_entity": lambda s, d: best_entity(notes(s, d), relations(s, d)),
}

_W = f"WITH {SQL_RELATIONS}"
_EDGES = f"{_W}, e AS (SELECT source_id AS src, target_id AS dst, max(weight) AS weight FROM rel GROUP BY ALL)"
_SEEDS = "seeds AS (SELECT DISTINCT src AS node FROM e WHERE try_cast(regexp_extract(src, '^note_[a-z]+_(\\d+)_', 1) AS INTEGER) % 50 = 0)"
_CASE = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_CAPS.items()) + f" ELSE {OTHER_CAP} END"
_VALUE = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REASONING.items()) + " ELSE 0.5 END"
_UND = ", ".join(f"'{x}'" for x in UNDIRECTED)

SQL = {
    "relation_dedup": f"""{_W} SELECT CASE WHEN u AND source_id > target_id THEN target_id ELSE source_id END AS source_id, CASE WHEN u AND source_id > target_id THEN source_id ELSE target_id END AS target_id,
  relation_type, max(weight) AS weight, count(*) AS n FROM (SELECT source_id, target_id, relation_type, weight, relation_type IN ({_UND}) AS u FROM rel) GROUP BY 1, 2, 3""",
    "relation_statistics": f"""{_W} SELECT relation_type, count(*) AS n, round(avg(weight), 6) AS mean_weight, round(stddev_pop(weight), 6) AS std_weight, min(weight) AS min_weight, max(weight) AS max_weight FROM rel GROUP BY relation_type""",
    "relation_top_by_type": f"""{_W} SELECT relation_type, relation_id, row_number() OVER (PARTITION BY relation_type ORDER BY weight DESC, relation_id)::INTEGER AS place FROM rel QUALIFY place <= {_CASE}""",
    "relation_reasoning": f"""{_W} SELECT relation_id, ({_VALUE})::DOUBLE AS reasoning FROM rel""",
    "node_degrees": f"""{_EDGES} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round(sum(weight), 6) AS total_weight FROM (SELECT src AS node, 1 AS o, 0 AS i, weight FROM e UNION ALL SELECT dst, 0, 1, weight FROM e) GROUP BY node""",
    "graph_audit": f"""{_W}, {SQL_NOTES}, ends AS (SELECT relation_id, source_id AS node FROM rel UNION ALL SELECT relation_id, target_id FROM rel),
a AS (SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM rel) AS edges, (SELECT count(DISTINCT relation_id) FROM ends WHERE node NOT IN (SELECT note_id FROM notes)) AS dangling,
  (SELECT count(*) FROM notes WHERE note_id NOT IN (SELECT node FROM ends)) AS isolated)
SELECT *, round(isolated / notes, 6)::DOUBLE AS isolated_ratio, round(isolated / notes, 6) > 0.3 AS too_isolated FROM a""",
    "two_hop_relations": f"""{_EDGES}, d AS (SELECT a.src, b.dst, max(round(a.weight * b.weight * 0.5, 8)) AS weight FROM e a JOIN e b ON a.dst = b.src WHERE a.weight * b.weight * 0.5 > 0.1 AND a.src <> b.dst GROUP BY ALL)
SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.src = d.src AND e.dst = d.dst) OR (e.src = d.dst AND e.dst = d.src))""",
    "neighbourhood": f"""{_EDGES}, {_SEEDS}, u AS (SELECT src, dst FROM e WHERE weight >= 0.35 UNION SELECT dst, src FROM e WHERE weight >= 0.35),
h AS (SELECT node, 0 AS distance FROM seeds UNION ALL SELECT dst, 1 FROM seeds JOIN u ON node = src UNION ALL SELECT b.dst, 2 FROM seeds JOIN u a ON node = a.src JOIN u b ON a.dst = b.src)
SELECT node, min(distance)::INTEGER AS distance FROM h GROUP BY node""",
    "strongest_neighbours": f"""{_EDGES} SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)::INTEGER AS place FROM e QUALIFY place <= 8""",
    "reasoning_paths": f"""{_EDGES}, {_SEEDS}, b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS turn FROM e),
p1 AS (SELECT node AS seed, [node, dst] AS path, [turn] AS turns, weight AS product, 1 AS hops FROM seeds JOIN b ON node = src), k1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY turns) AS place FROM p1 QUALIFY place <= 10),
p2 AS (SELECT seed, list_append(path, dst) AS path, list_append(turns, turn) AS turns, product * weight AS product, 2 AS hops FROM k1 JOIN b ON path[-1] = src WHERE NOT list_contains(path, dst)),
n1 AS (SELECT seed, count(*) AS n FROM k1 GROUP BY seed), k2 AS (SELECT p2.*, n + row_number() OVER (PARTITION BY seed ORDER BY turns) AS place FROM p2 JOIN n1 USING (seed) QUALIFY place <= 10),
p3 AS (SELECT seed, list_append(path, dst) AS path, list_append(turns, turn) AS turns, product * weight AS product, 3 AS hops FROM k2 JOIN b ON path[-1] = src WHERE NOT list_contains(path, dst)),
n2 AS (SELECT seed, count(*) AS n FROM (SELECT seed FROM k1 UNION ALL SELECT seed FROM k2) GROUP BY seed), k3 AS (SELECT p3.*, n + row_number() OVER (PARTITION BY seed ORDER BY turns) AS place FROM p3 JOIN n2 USING (seed) QUALIFY place <= 10)
SELECT seed, array_to_string(path, '>') AS path, hops, round(product / (1 + hops), 6) AS score FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)""",
    "note_components": f"""{_EDGES.replace('WITH', 'WITH RECURSIVE', 1)}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT src AS node, src AS component FROM u UNION SELECT u.dst, c.component FROM c JOIN u ON c.node = u.src)
SELECT node, min(component) AS component FROM c GROUP BY node""",
    "fusion_linear": f"""{_W}, s AS (SELECT source_id AS query, target_id AS candidate, relation_type, max(weight) AS s FROM rel WHERE relation_type IN ('semantic_similarity', 'reference', 'entity_coexistence') GROUP BY ALL),
n AS (SELECT *, max(s) OVER (PARTITION BY query, relation_type) AS top FROM s)
SELECT query, candidate, round(sum(CASE WHEN top > 0 THEN s / top ELSE 0.0 END * CASE relation_type WHEN 'semantic_similarity' THEN 0.5 WHEN 'reference' THEN 0.3 ELSE 0.2 END), 6)::DOUBLE AS score FROM n GROUP BY query, candidate""",
    "fusion_rank": f"""{_W}, s AS (SELECT source_id AS query, target_id AS candidate, relation_type, max(weight) AS s FROM rel GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query, relation_type ORDER BY s DESC, candidate) AS rank FROM s), f AS (SELECT query, candidate, round(sum(1 / (50 + rank)::DOUBLE), 8) AS score FROM n GROUP BY query, candidate)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) <= 80""",
    "evidence_merge": f"""{_W} SELECT target_id, count(*) AS hits, array_to_string(list_sort(list_distinct(list(relation_type))), ',') AS sources, arg_max(source_id, (weight, source_id)) AS best_source,
  round(0.6 * max(weight) + 0.3 * least(count(*) / 5.0::DOUBLE, 1.0) + 0.1 * least(count(DISTINCT relation_type) / 2.0::DOUBLE, 1.0), 6) AS score FROM rel GROUP BY target_id""",
    "zscore_blend": f"""{_W}, v AS (SELECT * FROM rel WHERE reasoning_value IS NOT NULL), m AS (SELECT relation_type, avg(weight) AS aw, stddev_pop(weight) AS sw, avg(reasoning_value) AS ar, stddev_pop(reasoning_value) AS sr FROM v GROUP BY relation_type)
SELECT relation_id, round(0.35 * CASE WHEN sw > 1e-9 THEN (weight - aw) / sw ELSE 0.0 END + 0.65 * CASE WHEN sr > 1e-9 THEN (reasoning_value - ar) / sr ELSE 0.0 END, 5)::DOUBLE AS score FROM v JOIN m USING (relation_type)""",
    "best_entity": f"""{_W}, {SQL_NOTES}, held AS (SELECT note_id, unnest(list_distinct(list_filter(entities, lambda e: trim(e) <> ''))) AS entity FROM notes), o AS (SELECT source_id, target_id, max(weight) AS weight FROM rel GROUP BY ALL),
f AS (SELECT o.source_id AS query, h.entity, sum(o.weight) AS s, count(*) AS n_notes FROM o JOIN held h ON h.note_id = o.target_id GROUP BY ALL),
g AS (SELECT query, entity, round(s * (1 + 0.03 * least(n_notes - 1, 3)), 6)::DOUBLE AS score, n_notes FROM f WHERE NOT EXISTS (SELECT 1 FROM held WHERE note_id = query AND held.entity = f.entity))
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, entity) = 1""",
}
