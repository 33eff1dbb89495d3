import os
import random
import re

import pytest

from noteflow.functions.runtime import stage
from noteflow.operators import graph, reasoning
from noteflow.plans import registry
from tests.oracle import connect

SF = os.environ.get("TEST_PATHS_SF_DIR", "/root/testdata/sf0.01")


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_paths_follow_all_neighbours_breadth_first(spark):
    seed = spark.createDataFrame([("a",), ("h",)], "node string")
    e = edges(spark, [("a", f"b{i}", 0.9 - i / 10) for i in range(6)] + [("b5", "c", 0.5), ("c", "d", 0.5), ("d", "x", 0.5)] + [("h", f"k{i:02d}", 1 - i / 100) for i in range(12)] + [("k00", "m", 1.0)])
    got = {}
    for r in graph.simple_paths(e, seed).collect():
        got.setdefault(r.seed, set()).add(">".join(r.path))
    assert got == {"a": {f"a>b{i}" for i in range(6)} | {"a>b5>c", "a>b5>c>d"}, "h": {f"h>k{i:02d}" for i in range(10)}}


def test_beams_take_six_branches_and_four_hops(spark):
    e = edges(spark, [("a", f"b{i}", 0.9 - i / 10) for i in range(7)] + [("b0", "c", 0.5), ("c", "d", 0.5), ("d", "x", 0.5), ("x", "y", 0.5)])
    got = {">".join(r.path) for r in reasoning.beam_search(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {f"a>b{i}" for i in range(6)} | {"a>b0>c", "a>b0>c>d", "a>b0>c>d>x"}


def test_a_hub_takes_no_more_branches_than_can_count(spark, monkeypatch):
    """The same paths as by brute force where all nodes have a hub with 400 neighbours, of which few branches are followed."""
    random.seed(4)
    pairs = {(f"n{i:03d}", "hub"): random.choice([0.5, 0.9]) for i in range(400)} | {(f"n{random.randrange(400):03d}", f"m{i % 40:02d}"): round(random.random(), 2) for i in range(300)}
    both = {**pairs, **{(b, a): w for (a, b), w in pairs.items()}}
    near = {}
    for (a, b), w in both.items():
        near.setdefault(a, []).append((-w, b))
    want, front = set(), {s: [(s,)] for s in ["hub", *(f"n{i:03d}" for i in range(0, 400, 20))]}
    for seed, paths in front.items():
        n = 0
        for _ in range(3):
            paths = [(*p, b) for p in paths for _, b in sorted(near[p[-1]]) if b not in p][: 10 - n]
            n += len(paths)
            want |= {(seed, ">".join(p)) for p in paths}
    rows = {}
    monkeypatch.setattr(graph, "stage", lambda df, name="stage": rows.setdefault(name, stage(df, name)) if name == "branches" else stage(df, name))
    got = graph.simple_paths(edges(spark, [(a, b, w) for (a, b), w in both.items()]), spark.createDataFrame([(s,) for s in front], "node string"))
    assert {(r.seed, ">".join(r.path)) for r in got.collect()} == want
    assert rows["branches"].where("src = 'hub'").count() == 13


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_node_chooses_diverse_paths_among_all_of_its_own(spark):
    """The first paths and scores of all nodes from the SQL of path_scores with every node as a seed, chosen one by one."""
    sql, every = re.subn(r"WHERE try_cast\(regexp_extract\(src, .*?\) AS INTEGER\) % 50 = 0", "", registry.oracle_sql()["path_scores"])
    assert every == 1 and sql.endswith(" SELECT * FROM sc")
    own = {}
    for seed, path_id, score in connect(SF).execute(sql.replace(" SELECT * FROM sc", " SELECT p0.seed, path_id, score FROM p0 JOIN sc USING (path_id)")).fetchall():
        own.setdefault(seed, []).append((-score, path_id))
    want = set()
    for seed, rows in own.items():
        least = 0.3 if sum(x <= -0.3 for x, _ in rows) >= 3 else 0.3 * 0.7
        chosen = []
        for x, path_id in sorted(rows):
            nodes = set(path_id.split(">"))
            if -x >= least and len(chosen) < 10 and all(1 - len(nodes & y) / len(nodes | y) >= 0.7 for y in chosen):
                chosen.append(nodes)
                want.add((seed, path_id, len(chosen), -x))
    got = registry.queries()["paths_diverse"](spark, SF).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert len({r.seed for r in got}) > 500
