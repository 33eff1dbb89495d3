import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import hot_keys, lookup_join, stage
from noteflow.operators import evaluation, graph, incremental, learned, lexical, notes, vectors
from noteflow.plans import registry
from tests.oracle import SF


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_sentences_and_tokens(spark):
    assert column(spark, ["A b. C!  D", "好。是", None, " "], tx.sentences) == [["A b.", "C!", "D"], ["好。", "是"], [], []]
    assert column(spark, ["It's Ümlaut_1 好", None], tx.tokens) == [["it", "s", "ümlaut_1", "好"], []]
    assert column(spark, [None, "", " \t　", "x"], tx.blank)[:2] == [True, True]


def chunks_by_hand(text, size, overlap):
    done, cur = [], ""
    for s in [x for x in __import__("re").split(r"(?<=[.!?])\s*", text) if x]:
        joined = s if not cur else f"{cur} {s}"
        if not cur or len(joined) <= size:
            cur = joined
        else:
            done.append(cur)
            tail = cur[-overlap:] if overlap else ""
            cur = f"{tail} {s}" if tail else s
    return [*done, cur] if cur else done


@pytest.mark.parametrize("overlap", [0, 7])
def test_chunks_match_a_loop(spark, overlap):
    random.seed(overlap)
    texts = [" ".join("w" * random.randint(1, 9) + random.choice([".", "!", ""]) for _ in range(random.randint(1, 40))).strip() for _ in range(40)]
    assert column(spark, texts, lambda c: tx.chunk_by_length(c, 40, overlap)) == [chunks_by_hand(t, 40, overlap) for t in texts]


def test_jaccard_of_empty_texts_is_zero(spark):
    assert column(spark, ["", None, "a b"], lambda c: tx.jaccard(tx.word_set(c), tx.word_set(F.lit("b c")))) == [0.0, 0.0, pytest.approx(1 / 3)]
    assert column(spark, [""], lambda c: tx.jaccard(tx.word_set(c), tx.word_set(c))) == [0.0]


def test_lookup_join_keeps_hot_keys_whole(spark):
    big = stage(spark.range(90_000).selectExpr("if(id % 3 = 0, 7, id) k", "id v"))
    small = spark.createDataFrame([(7, "hot"), (8, "cold"), (100_001, "none")], "k bigint, x string")
    assert hot_keys(big, ["k"]).count() == 1
    got = lookup_join(big, small, ["k"])
    assert got.groupBy("x").count().orderBy("x").collect() == [("cold", 1), ("hot", 30_000 + 1)]
    assert lookup_join(big, small, ["k"], "left_anti").count() == 90_000 - 30_002
    assert lookup_join(big.limit(0), small, ["k"]).count() == 0


def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_components_match_union_find(spark):
    random.seed(3)
    pairs = [(f"n{random.randint(0, 120):03d}", f"n{random.randint(0, 120):03d}") for _ in range(70)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("x", "x")]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(edge_frame(spark, pairs)).collect()}
    assert got == {n: find(n) for n in parent}


def test_components_of_nothing(spark):
    assert graph.components(edge_frame(spark, [])).count() == 0


def test_pagerank_matches_power_iteration(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d"), ("c", "f")]
    nodes = sorted({x for p in pairs for x in p})
    m = np.zeros((len(nodes),) * 2)
    for a, b in pairs:
        m[nodes.index(b), nodes.index(a)] = 1
    out = m.sum(axis=0)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(10):
        r = 0.15 / len(nodes) + 0.85 * ((m / np.where(out, out, 1)) @ r + r[out == 0].sum() / len(nodes))
    got = {x.node: x.rank for x in graph.pagerank(edge_frame(spark, pairs)).collect()}
    assert got == pytest.approx(dict(zip(nodes, r)), abs=1e-9)
    assert graph.pagerank(edge_frame(spark, [])).count() == 0


def test_hops_and_paths(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("c", "a")])
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.distance) for r in graph.hops(e, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r.path) for r in graph.simple_paths(e, seeds, 3).collect()} == {("a", "b"), ("a", "b", "c"), ("a", "b", "c", "d")}


def test_shared_entity_pairs_match_a_loop(spark):
    random.seed(5)
    rows = [(f"n{i}", [random.choice(["hot", "a", "b", "c", " d", "", None]) for _ in range(random.randint(0, 6))]) for i in range(60)]
    got = {(r.note_a, r.note_b): r.shared for r in notes.shared_entity_pairs(spark.createDataFrame(rows, "note_id string, entities array<string>")).collect()}
    sets = {n: {x.strip() for x in e if x and x.strip()} for n, e in rows}
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.permutations(sets, 2) if a < b and len(sets[a] & sets[b]) >= 2}


def test_bm25_matches_the_formula(spark):
    docs = {1: "the cat sat", 2: "the dog", 3: "cat cat dog", 4: None, 5: ""}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id int, text string")
    q = spark.createDataFrame([(9, "cat cat the")], "query_id int, query string")
    got = {r.doc_id: r.score for r in lexical.bm25(df, q).collect()}
    words = {k: (v or "").split() for k, v in docs.items()}
    mean = sum(map(len, words.values())) / 5

    def score(w):
        s = 0.0
        for t, times in (("cat", 2), ("the", 1)):
            df_, tf = sum(t in x for x in words.values()), w.count(t)
            s += times * math.log((5 - df_ + 0.5) / (df_ + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
        return s

    assert got == pytest.approx({k: score(w) for k, w in words.items() if score(w)})


def test_vector_search_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, [float("nan")] * 8), (902, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in vectors.search(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = x.astype(float) / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    assert got == {i: np.lexsort((np.arange(300), -s[i]))[:5].tolist() for i in range(0, 300, 50)}


def test_elbow(spark):
    points = spark.createDataFrame([(2, 100.0), (3, 40.0), (4, 35.0), (5, 33.0)], "k int, inertia double")
    assert vectors.elbow(points).first().k == 3
    assert vectors.elbow(points.limit(2)).count() == 0


def test_file_changes(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4")], "path string, hash string")
    changes = incremental.diff_states(a, b)
    assert dict(changes.collect()) == {"x": "unchanged", "y": "modified", "z": "deleted", "w": "new"}
    depends = spark.createDataFrame([("x", "z")], "path string, on string")
    assert dict(incremental.processing_plan(changes, depends).collect()) == {"x": "process", "y": "process", "z": "clean", "w": "process"}


def test_learned_scorer_beats_the_base_rate(spark):
    sf = "/root/testdata/sf0.01"
    q, p = evaluation.items(spark, sf), evaluation.passages(spark, sf)
    f = stage(learned.passage_features(q, p))
    s = learned.score(learned.fit_scorer(f.where(~learned.held_out())), f.where(learned.held_out())).where("label IS NOT NULL").toPandas()
    pos, neg = s.score[s.label == 1].values, s.score[s.label == 0].values
    auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert auc > 0.55


def test_queries_survive_empty_tables(spark, tmp_path):
    for f in ("atomic_notes", "note_relations", "qa_results", "paragraphs", "documents", "note_embeddings", "embeddings", "alias_entries"):
        spark.read.parquet(f"{SF}/{f}.parquet").limit(0).write.parquet(f"{tmp_path}/{f}.parquet")
    for name, query in registry.queries().items():
        if name in ("vector_cells", "ivf_recall", "learned_passage_scores"):  # there is nothing to fit
            continue
        assert query(spark, str(tmp_path)).count() <= 1, name


def test_all_cells_give_the_exact_result(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 6))
    df = stage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"))
    q = df.where("vec_id % 50 = 0")
    index, model = vectors.ivf_index(df, "vec_id", "embedding", 8)
    exact = {(r.query_id, r.id) for r in vectors.search(df, q, "vec_id", "embedding").collect()}
    assert {(r.query_id, r.id) for r in vectors.ivf_search(stage(index), model, q, "vec_id", "embedding", 8).collect()} == exact
    probes, tried = vectors.tune_probes(df, q, "vec_id", "embedding")
    assert tried[-1][1] >= 0.9 and probes == tried[-1][0] and all(a[1] <= b[1] for a, b in zip(tried, tried[1:]))
