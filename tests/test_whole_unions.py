from noteflow.operators import graph, retrieval


def test_union_keeps_every_candidate(spark):
    one = spark.createDataFrame([("q", f"a{i:02d}", 1.0 - i / 100) for i in range(15)], "query string, candidate string, score double")
    two = spark.createDataFrame([("q", f"a{i:02d}", 9.0) for i in range(10, 25)], "query string, candidate string, score double")
    got = [(r.candidate, r.tier) for r in retrieval.ordered_union(one, two).orderBy("place").collect()]
    assert got == [(f"a{i:02d}", 1 if i < 15 else 2) for i in range(25)]


def test_fusion_ranks_all_and_cuts_the_fused_list(spark):
    rows = [("q", f"c{i:03d}", "x", 1 - i / 1000) for i in range(100)] + [("q", f"c{i:03d}", "y", i / 1000) for i in range(100)]
    r = spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, weight double")
    scores = {f"c{i:03d}": round(1 / (51 + i) + 1 / (150 - i), 8) for i in range(100)}
    got = {x.candidate: x.score for x in graph.rank_fusion(r).collect()}
    assert got == {c: scores[c] for c in sorted(scores, key=lambda c: (-scores[c], c))[:80]}
