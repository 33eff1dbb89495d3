from noteflow.operators import retrieval


def test_the_tail_of_the_second_hop_starts_at_a_tenth(spark):
    c = spark.createDataFrame([("q", f"c{i}", 2, s) for i, s in enumerate([0.5] * 5 + [0.15, 0.12, 0.1, 0.09])], "query string, candidate string, hop int, score double")
    assert {r.candidate for r in retrieval.hop_filter(c).collect()} == {f"c{i}" for i in range(8)}
