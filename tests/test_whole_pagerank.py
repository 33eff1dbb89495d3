import numpy as np
import pytest

from noteflow.operators import graph


def test_pagerank_converges_on_a_long_path(spark):
    n = 60
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0 + (i == 0) * 50) for i in range(n - 1)], "src string, dst string, weight double")
    m = np.zeros((n, n))
    for i in range(n - 1):
        m[i, i + 1] = m[i + 1, i] = 1.0 + (i == 0) * 50
    want = np.linalg.solve(np.eye(n) - 0.85 * m / m.sum(axis=0), np.full(n, 0.15 / n))
    both = graph.undirected(e)
    got = {r.node: r.rank for r in graph.pagerank(both, None).collect()}
    # a summed change under n * 1e-6 = 6e-5 leaves a summed error of at most 0.85 / 0.15 times that
    assert sum(abs(got[f"n{i:02d}"] - want[i]) for i in range(n)) < 6e-5 * 0.85 / 0.15
    ten = {r.node: r.rank for r in graph.pagerank(both).collect()}
    assert sum(abs(ten[f"n{i:02d}"] - want[i]) for i in range(n)) > 6e-5 * 0.85 / 0.15
    assert sum(got.values()) == pytest.approx(1)
