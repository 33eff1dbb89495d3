import numpy as np
import pytest

from noteflow.llm.neighbours import K, nearest, search

SCHEMA = "vec_id bigint, embedding array<float>, sim double"


def truth(rows, d):
    good = {}
    for i, e in rows:
        if i is not None and e is not None and len(e) == d and None not in e and np.isfinite(e).all() and np.any(e):
            good[i] = np.array(e, np.float32).astype(float)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    return {int(i): [(int(ids[j]), s[a, j]) for j in np.lexsort((ids, -s[a]))[: min(K, len(ids) - 1)]] for a, i in enumerate(ids)}


def found(spark, rows, d):
    df = spark.createDataFrame([(i, e, 0.5) for i, e in rows], SCHEMA)
    got = {}
    for r in nearest(df, dimension=d).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.sim))
    return got


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, d))
    return (centres[rng.integers(0, 25, n)] + 0.3 * rng.standard_normal((n, d))).astype(np.float32)


def test_recall_on_many_blocks(spark):
    x = clustered(4000, 16, 1)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows, 16), truth(rows, 16)
    hits = sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in want)
    assert hits / (K * len(want)) > 0.98
    assert all(len(v) == K for v in got.values())


def test_copies_and_ties_are_exact(spark):
    x = clustered(60, 8, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[5].tolist()) for i in range(40)] + [(200 + i, (2 * x[5]).tolist()) for i in range(2)]
    rows += [(3, x[3].tolist())]  # delivered twice
    got, want = found(spark, rows, 8), truth(rows, 8)
    assert got.keys() == want.keys()
    for i in want:
        assert [a for a, _ in got[i]] == [a for a, _ in want[i]]
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-12)


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1e-30, 1e-30])]
    got = found(spark, rows, 2)
    assert {i: [a for a, _ in v] for i, v in got.items()} == {1: [8, 9], 8: [9, 1], 9: [8, 1]}


def test_few_or_no_vectors(spark):
    assert found(spark, [(1, [1.0, 0.0])], 2) == {}
    assert found(spark, [], 2) == {}


def test_hot_copies(spark):
    x = clustered(200, 8, 4)
    rows = [(i, (x[0] if i % 3 == 0 else x[i % 200]).tolist()) for i in range(900)]
    got, want = found(spark, rows, 8), truth(rows, 8)
    same = sum([a for a, _ in got[i]] == [a for a, _ in want[i]] for i in want)
    assert same / len(want) > 0.99


def test_greedy_search_recall(spark):
    x = clustered(4000, 16, 7)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, e, 0.5) for i, e in rows], SCHEMA)
    got = {}
    for r in search(df, df.where("vec_id % 50 = 0"), dimension=16).collect():
        got.setdefault(r.query_id, set()).add(r.other)
    want = truth(rows, 16)
    assert sum(len(got[i] & {a for a, _ in want[i]}) for i in range(0, 4000, 50)) / (K * 80) > 0.95
    assert search(df.limit(0), df.limit(0), dimension=16).count() == 0
