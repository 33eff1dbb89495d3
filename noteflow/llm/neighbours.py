"""Problem 5: the k most similar vectors of every vector, by NN-descent.

Equal vectors are one vertex. The graph starts from random-projection trees (fitted on a bounded sample; every vertex
is in one bounded block of each tree and gets its best neighbours there) and is improved by rounds of neighbours of
neighbours: each vertex joins its new and old, forward and reverse neighbours with each other, and every vertex keeps
the best it has met, until a round changes next to nothing.

A round is two shuffles: edges go to the block of their vertex, and each block gets one copy of every vector that its
edges name. As blocks are regions of the space, that is little more than the table itself, not one vector per edge.
All block work is dense matrix algebra in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions.runtime import drop_stage, lookup_join, parallelism, stage, table

DIMENSION = 128
K = 10
#: Neighbours kept per vertex while the graph is built, and reverse neighbours that take part in a round.
GRAPH_K, REVERSE_K = 16, 16
TREES, LEAF, FIT_ROWS = 3, 300, 20_000
#: The rounds end when fewer than this share of all edges is new.
SETTLED = 0.002
#: A search starts from at most ENTRIES vertices (a sample) and keeps BEAM candidates per query.
ENTRIES, BEAM = 2000, 24


def usable(embedding: str, dimension: int = DIMENSION) -> Column:
    """True for `dimension` finite values that are not all zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(e) == dimension) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of a binary column as unit vectors in double precision."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dimension).astype(np.float64)
    # a power of two, so that huge and tiny vectors neither overflow nor vanish when squared
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, initial=1e-300))[1][:, None])
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


class Tree:
    """A random-projection tree: inner nodes split by a hyperplane, each leaf is a cell with a direction of its own."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        least = max(8, int(leaf * len(sample) / max(rows, 1)))
        self.normals, self.offsets, self.children = [], [], []
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            me = len(self.normals)
            if parent >= 0:
                self.children[parent][side] = me
            normal = self._direction(sample[at], rng)
            projected = sample[at] @ normal
            offset = float(np.median(projected))
            right = projected > offset
            self.normals.append(normal)
            self.offsets.append(offset)
            self.children.append([-1, -1])
            if len(at) > least and 0 < right.sum() < len(at):
                todo += [(at[~right], me, 0), (at[right], me, 1)]
        self.normals, self.offsets, self.children = np.array(self.normals), np.array(self.offsets), np.array(self.children)

    @staticmethod
    def _direction(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """From one centre of a rough two-means of the points to the other."""
        if len(points) < 2:
            return rng.standard_normal(points.shape[1])
        some = points[rng.choice(len(points), min(len(points), 256), replace=False)]
        a, b = some[0], some[1]
        for _ in range(4):
            near = some @ (a - b) > (a @ a - b @ b) / 2
            if not 0 < near.sum() < len(some):
                return rng.standard_normal(points.shape[1])
            a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
        return a - b

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and where the row lies along the cell's direction."""
        node = np.zeros(len(x), np.int64)
        while True:
            along = np.einsum("ij,ij->i", x, self.normals[node])
            child = self.children[node, (along > self.offsets[node]).astype(np.int64)]
            if (child < 0).all():
                return node, along
            node = np.where(child < 0, node, child)


def vertices(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", dimension: int = DIMENSION) -> tuple[DataFrame, DataFrame]:
    """Staged tables: members (vid, id: each usable key once) and vertices (vid, vec, ids: the K + 1 smallest keys).

    vid stands for an exact vector (0.0 and -0.0 alike). A key that occurs with several vectors keeps one of them.
    """
    rows = vectors.where(usable(embedding, dimension) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.transform(embedding, lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("e")
    )
    hashes = stage(
        rows.groupBy("id").agg(F.min("e").alias("e")).select("id", F.xxhash64("e").alias("vid"), "e"), "vectors"
    )
    smallest = (
        hashes.select("vid", "id")
        .withColumn("n", F.row_number().over(Window.partitionBy("vid").orderBy("id")))
        .where(F.col("n") <= K + 1)
        .groupBy("vid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )

    def pack(batches):
        for b in batches:
            flat = b.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)
            yield pa.RecordBatch.from_arrays(
                [b.column("vid"), pa.array([r.tobytes() for r in flat], pa.binary()), b.column("ids")], ["vid", "vec", "ids"]
            )

    # each vector is carried by the row of its smallest key only, so a hot vector is not shuffled
    first = smallest.select("vid", "ids", F.col("ids")[0].alias("id"))
    out = hashes.select("id", "e").join(first, "id").mapInArrow(pack, "vid bigint, vec binary, ids array<bigint>")
    return hashes.select("vid", "id"), stage(out, "vertices")


def blocks(points: DataFrame, rows: int, dimension: int = DIMENSION, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vid, vec, block (array, one block per tree). Cells larger than 2 * leaf are cut along their direction, so no
    block is larger, however the data lie."""
    # chosen by hash from the whole table, about FIT_ROWS rows
    sample = [r[0] for r in points.where(F.pmod(F.xxhash64("vid"), F.lit(-(-rows // FIT_ROWS))) == 0).select("vec").collect()] if rows else []
    if not sample:
        return points.select("vid", "vec", F.array_repeat(F.lit(0).cast("bigint"), trees).alias("block"))
    x = _matrix(pa.chunked_array([pa.array(sample, pa.binary())]), dimension)
    shared = points.sparkSession.sparkContext.broadcast([Tree(x, rows, leaf, 100 + t) for t in range(trees)])

    def place(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("vec"), dimension)
                for t, tree in enumerate(shared.value):
                    cell, along = tree.place(m)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("vid"), pa.array(np.full(len(m), t, np.int32)), pa.array(cell), pa.array(along)],
                        ["vid", "tree", "cell", "along"],
                    )

    placed = points.select("vid", "vec").mapInArrow(place, "vid bigint, tree int, cell bigint, along double")
    w = Window.partitionBy("tree", "cell")
    rank = F.row_number().over(w.orderBy("along", "vid")) - 1
    cut = F.floor(rank * F.ceil(F.count("vid").over(w) / (2 * leaf)) / F.count("vid").over(w))
    own = placed.select("vid", "tree", (F.col("cell") * (1 << 32) + cut).cast("bigint").alias("b"))
    one = own.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("tree", "b"))).alias("l"))
    return points.select("vid", "vec").join(one.select("vid", F.col("l.b").alias("block")), "vid")


def _best(v: np.ndarray, w: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of each v's k best distinct w."""
    order = np.lexsort((w, -sim, v))
    v, w = v[order], w[order]
    # equal pairs have equal similarities up to rounding; the merge in Spark removes what is left of them
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    order, v = order[fresh], v[fresh]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    rank = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
    return order[rank < k]


_EDGES = "v bigint, vb bigint, w bigint, wb bigint, sim double"


def _edge_table(v, vb, w, wb, sim) -> pa.Table:
    kinds = [pa.int64()] * 4 + [pa.float64()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("v", "vb", "w", "wb", "sim"), (v, vb, w, wb, sim), kinds, strict=True)})


def _first_edges(points: DataFrame, dimension: int, k: int) -> DataFrame:
    """The best neighbours of each vertex within its block of each tree."""

    def run(t: pa.Table) -> pa.Table:
        x, ids, home = _matrix(t.column("vec"), dimension), t.column("vid").to_numpy(), t.column("home").to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -2)
        n = min(k, len(ids) - 1)
        if n < 1:
            return _edge_table(*[np.zeros(0)] * 5)
        w = np.argpartition(-s, n - 1, axis=1)[:, :n].ravel()
        v = np.repeat(np.arange(len(ids)), n)
        return _edge_table(ids[v], home[v], ids[w], home[w], s[v, w])

    spread = points.select("vid", "vec", F.col("block")[0].alias("home"), F.posexplode("block").alias("tree", "b"))
    n = 4 * parallelism(points.sparkSession)
    return spread.repartition(n, "tree", "b").groupBy("tree", "b").applyInArrow(run, _EDGES)


def _merge(edges: DataFrame, k: int) -> DataFrame:
    """Each vertex's k best distinct neighbours; an edge is new unless it was there before the round."""
    one = edges.groupBy("v", "w").agg(
        F.first("vb").alias("vb"), F.first("wb").alias("wb"), F.max("sim").alias("sim"), F.min("new").alias("new")
    )
    best = Window.partitionBy("v").orderBy(F.desc("sim"), "w")
    return one.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def _round(points: DataFrame, edges: DataFrame, dimension: int, k: int, reverse: int, spent: list[DataFrame]) -> DataFrame:
    """Neighbours of neighbours: candidate edges that are better than what their vertex has. Staged tables that only this
    round reads are added to `spent`."""
    back = edges.select(F.col("w").alias("v"), F.col("wb").alias("vb"), F.col("v").alias("w"), "sim", "new")
    pick = Window.partitionBy("v").orderBy(F.desc("new"), F.desc("sim"), "w")
    back = back.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= reverse)
    around = edges.select("v", "vb", "w", "sim", "new").unionByName(back.drop("n"))
    around = around.groupBy("v", "vb", "w").agg(F.max("new").alias("new"))
    active = around.where("new").select("v").distinct()
    around = stage(around.join(active, "v", "left_semi").select("vb", "v", "w", "new"), "around")
    spent.append(around)
    worst = edges.groupBy("v").agg(F.when(F.count("w") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    needed = (
        around.select(F.col("vb").alias("nb"), F.col("w").alias("vid")).distinct()
        .join(points.select("vid", "vec", F.col("block")[0].alias("home")), "vid")
        .join(worst.withColumnRenamed("v", "vid"), "vid", "left")
        .select("nb", "vid", "vec", "home", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    )

    def run(links: pa.Table, named: pa.Table) -> pa.Table:
        ids = named.column("vid").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        home, worst_ = named.column("home").to_numpy()[order], named.column("worst").to_numpy()[order]
        x = _matrix(named.column("vec"), dimension)[order]
        v, w = links.column("v").to_numpy(), np.searchsorted(ids, links.column("w").to_numpy())
        new = links.column("new").to_numpy(zero_copy_only=False)
        by = np.argsort(v, kind="stable")
        v, w, new = v[by], w[by], new[by]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        lengths = np.diff(np.append(starts, len(v)))
        found = []
        for a in range(0, len(starts), 256):  # vertices at a time
            s, n = starts[a : a + 256], lengths[a : a + 256]
            at = np.minimum(s[:, None] + np.arange(n.max()), len(v) - 1)
            there = np.arange(n.max()) < n[:, None]
            wi, ni = w[at], new[at] & there
            m = x[wi]
            sims = m @ m.transpose(0, 2, 1)
            ok = there[:, :, None] & there[:, None, :] & (ni[:, :, None] | ni[:, None, :]) & (wi[:, :, None] != wi[:, None, :])
            ok &= sims > worst_[wi][:, :, None]
            g, i, j = np.nonzero(ok)
            p, q, sim = wi[g, i], wi[g, j], sims[g, i, j]
            keep = _best(p, q, sim, k)
            found.append((p[keep], q[keep], sim[keep]))
        p, q, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = _best(p, q, sim, k)
        p, q, sim = p[keep], q[keep], sim[keep]
        return _edge_table(ids[p], home[p], ids[q], home[q], sim)

    n = 4 * parallelism(points.sparkSession)
    return (
        around.repartition(n, "vb").groupBy("vb")
        .cogroup(needed.repartition(n, "nb").groupBy("nb"))
        .applyInArrow(run, _EDGES)
    )


def neighbour_graph(
    points: DataFrame, rows: int, dimension: int = DIMENSION, k: int = GRAPH_K
) -> DataFrame:
    """v, w, sim: the k nearest vertices of each vertex, nearly always. points: staged vid, vec."""
    placed = stage(blocks(points, rows, dimension), "placed")
    edges = stage(_merge(_first_edges(placed, dimension, k).withColumn("new", F.lit(True)), k), "edges")
    while True:  # similarities only grow, so this ends
        spent = [edges]
        met = _round(placed, edges, dimension, k, REVERSE_K, spent).withColumn("new", F.lit(True))
        edges = stage(_merge(edges.withColumn("new", F.lit(False)).unionByName(met), k), "edges")
        drop_stage(*spent)
        if edges.where("new").count() <= SETTLED * rows * k:
            break
    return edges.select("v", "w", "sim")


def nearest(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", dimension: int = DIMENSION
) -> DataFrame:
    """id, other, sim, rank: the K most similar other vectors of each usable vector, each key once.

    sim is the cosine rounded to 12 decimals; of equal ones the smaller key goes first. Unusable vectors (null, wrong
    length, null or non-finite values, all zero) and null keys stay out; a table with fewer than K + 1 usable vectors
    gives what there is. Other columns are ignored.
    """
    members, points = vertices(vectors, key, embedding, dimension)
    graph = neighbour_graph(points, points.count(), dimension)
    own = points.select(F.col("vid").alias("v"), F.lit(1.0).alias("sim"), "ids")
    near = graph.join(points.select(F.col("vid").alias("w"), "ids"), "w").select("v", F.round("sim", 12).alias("sim"), "ids")
    each = own.unionByName(near).select("v", "sim", F.explode("ids").alias("other"))
    w = Window.partitionBy("v").orderBy(F.desc("sim"), "other")
    lists = (
        each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= K + 1)
        .groupBy(F.col("v").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("n", "other", "sim"))).alias("l"))
    )
    joined = lookup_join(members, lists, ["vid"])
    others = F.slice(F.filter("l", lambda x: x["other"] != F.col("id")), 1, K)
    return joined.select("id", F.posexplode(others).alias("p", "x")).select(
        "id", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"), (F.col("p") + 1).alias("rank")
    )


def search_graph(points: DataFrame, graph: DataFrame, queries: DataFrame, dimension: int = DIMENSION, beam: int = BEAM) -> DataFrame:
    """q, vid, sim: up to `beam` vertices near each query, by greedy search: from the best of a sample of entries, the
    best candidates not yet looked at give their neighbours (in both directions) until none of the best is new.

    points: staged vid, vec; graph: v, w; queries: staged q, vec, each q once. The sample is bounded, whatever the size of the
    graph; each step joins the few candidates of each query with the edges and vectors of just these.
    """
    edges = graph.select("v", "w").union(graph.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct()
    # a hub's reverse edges are cut to the graph's degree by hash: the search has other ways to it
    pick = Window.partitionBy("v").orderBy(F.xxhash64("v", "w"))
    edges = stage(edges.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= 3 * GRAPH_K).drop("n"), "search-edges")
    start = [(r[0], bytes(r[1])) for r in points.orderBy(F.xxhash64("vid")).limit(ENTRIES).select("vid", "vec").collect()]
    if not start:
        return points.select(F.col("vid").alias("q"), "vid", F.lit(0.0).alias("sim")).limit(0)
    ids = np.array([i for i, _ in start])
    shared = points.sparkSession.sparkContext.broadcast((ids, _matrix(pa.chunked_array([pa.array([v for _, v in start], pa.binary())]), dimension)))

    def enter(batches):
        names, x = shared.value
        for b in batches:
            if b.num_rows:
                sims = _matrix(b.column("vec"), dimension) @ x.T
                n = min(beam, len(names))
                best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                row = np.repeat(np.arange(len(sims)), n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("q").take(pa.array(row)), pa.array(names[best.ravel()]), pa.array(sims[row, best.ravel()])], ["q", "vid", "sim"]
                )

    def compare(asked: pa.Table, near: pa.Table) -> pa.Table:
        if not near.num_rows or not asked.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "vid": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        sims = _matrix(near.column("vec"), dimension) @ _matrix(asked.column("vec"), dimension)[0]
        return pa.table({"q": near.column("nq"), "vid": near.column("vid"), "sim": pa.array(sims)})

    best = stage(queries.mapInArrow(enter, "q bigint, vid bigint, sim double").withColumn("looked", F.lit(False)), "beam")
    seen = best.select("q", "vid")
    n = 2 * parallelism(points.sparkSession)
    while True:  # until all of the best have been looked at
        ahead = best.where(~F.col("looked")).select("q", F.col("vid").alias("v"))
        new = ahead.join(edges, "v").select("q", F.col("w").alias("vid")).distinct().join(seen, ["q", "vid"], "left_anti")
        near = stage(new.join(points.select("vid", "vec"), "vid").select(F.col("q").alias("nq"), "vid", "vec"), "candidates")
        if near.isEmpty():
            break
        scored = queries.repartition(n, "q").groupBy("q").cogroup(near.repartition(n, "nq").groupBy("nq")).applyInArrow(compare, "q bigint, vid bigint, sim double")
        seen = stage(seen.unionByName(near.select(F.col("nq").alias("q"), "vid")), "seen")
        w = Window.partitionBy("q").orderBy(F.desc("sim"), "vid")
        both = best.withColumn("looked", F.lit(True)).unionByName(scored.withColumn("looked", F.lit(False)))
        best = stage(both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= beam).drop("n"), "beam")
    return best.select("q", "vid", "sim")


def search(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", embedding: str = "embedding", dimension: int = DIMENSION
) -> DataFrame:
    """query_id, other, sim, rank: the K vectors most similar to each query (key, embedding) that the graph search finds,
    the query's own key left out; ties by key. Unusable vectors and queries stay out."""
    _, points = vertices(vectors, key, embedding, dimension)
    graph = stage(neighbour_graph(points, points.count(), dimension), "graph")
    rows = queries.where(usable(embedding, dimension) & F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("q")).agg(F.min(embedding).alias("e"))

    def pack(batches):
        for b in batches:
            flat = b.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)
            yield pa.RecordBatch.from_arrays([b.column("q"), pa.array([r.tobytes() for r in flat], pa.binary())], ["q", "vec"])

    asked = stage(rows.mapInArrow(pack, "q bigint, vec binary"), "queries")
    hits = search_graph(points, graph, asked, dimension).join(points.select("vid", "ids"), "vid")
    each = hits.select(F.col("q").alias("query_id"), F.explode("ids").alias("other"), F.round("sim", 12).alias("sim")).where("other != query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "other")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K)


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 50 as queries against all vectors, by greedy search of the graph."""
    t = table(spark, sf_dir, "note_embeddings")
    return search(t, t.where("vec_id % 50 = 0"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which at least one is among the 10 most similar to the other."""
    n = nearest(table(spark, sf_dir, "note_embeddings"))
    return n.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


QUERIES = {"p5_found": p5_found, "p5_search": p5_search}
SQL: dict[str, str] = {}
