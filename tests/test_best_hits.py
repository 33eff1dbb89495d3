import random

import pytest

from noteflow.operators import lexical


def _tables(spark):
    rnd = random.Random(3)
    words = "the of a north river bridge mill tower harbour guild parish".split()
    text = lambda n: " ".join(rnd.choices(words, k=rnd.randint(0, n)))
    docs = spark.createDataFrame([(i, text(4), text(12)) for i in range(400)], "doc_id bigint, title string, text string").repartition(5)
    queries = spark.createDataFrame([(i, text(4)) for i in range(30)] + [(100, "the the of"), (101, "unheard"), (102, None)], "query_id bigint, query string")
    return docs, queries


CASES = {
    "bm25_search": (lambda d, q: lexical.bm25(d, q), {}),
    "field_bm25_search": (lambda d, q: lexical.field_bm25(d, q), {"fields": lexical.FIELD_WEIGHTS}),
    "tfidf_search": (lambda d, q: lexical.tfidf_cosine(d, q), {"cosine": True}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_few_rows_leave_the_scan_and_none_of_the_best_is_lost(spark, monkeypatch, name):
    monkeypatch.setattr(lexical, "BLOCK", 30)
    monkeypatch.setattr(lexical, "QUERY_SLICE", 10)
    docs, queries = _tables(spark)
    every, options = CASES[name]
    scored, best = every(docs, queries), lexical.best_hits(docs, queries, **options)
    rows = lambda df: sorted(map(tuple, lexical.top_hits(df, "doc_id").collect()))
    assert rows(best) == rows(scored)
    tasks = max(2 * spark.sparkContext.defaultParallelism, 5)
    assert best.count() <= tasks * 10 * 33


@pytest.mark.parametrize("name", sorted(CASES))
def test_the_registered_search_takes_the_best_where_they_are_read(spark, monkeypatch, name):
    called = []
    whole = lexical.best_hits
    monkeypatch.setattr(lexical, "best_hits", lambda *a, **k: called.append(k) or whole(*a, **k))
    monkeypatch.setattr(lexical, "_docs", lambda s, d: _tables(s)[0])
    lexical.QUERIES[name](spark, "").collect()
    assert called == [CASES[name][1]]
