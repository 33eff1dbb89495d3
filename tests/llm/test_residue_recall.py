import math
import random

import numpy as np
from pyspark.sql import functions as F

from noteflow.functions.runtime import stage
from noteflow.llm import residue


def made(seed):
    """Texts around the similarity of 0.8, in families of four, and a chain of 24: {id: text}, ids of the labelled ones."""
    random.seed(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = {}
    for _ in range(150):
        base = random.sample(words, random.randint(30, 150))
        texts[len(texts)] = base
        for _ in range(3):
            copy = list(base)
            for i in random.sample(range(len(copy)), random.randint(1, max(1, len(copy) // 35))):
                copy[i] = random.choice(words)
            texts[len(texts)] = copy
    seeds = set(range(0, len(texts), 4)) | {len(texts)}
    chain = random.sample(words, 60 + 5 * 24)
    for i in range(24):
        texts[len(texts)] = chain[3 * i : 3 * i + 60]
    return {k: " ".join(v) for k, v in texts.items()}, seeds


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def spread_from(spark, texts, seeds):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    plan = residue.table_plan(len(texts))
    marks = stage(residue.text_marks(docs, math.ceil(plan[0] * plan[1] / 64)).withColumn("kind", F.when(F.col("doc_id").isin(*seeds), "error")))
    found = {r.vid for r in residue.spread_labels(marks, docs, plan).collect()}
    return {r.doc_id for r in marks.collect() if r.vid in found}


def test_labels_spread_as_far_as_brute_force(spark, monkeypatch):
    """The tables find nearly all that brute force finds, nothing else, and the whole chain; slices of two change nothing."""
    texts, seeds = made(8)
    sets = {k: set(s.tolist()) for k, s in zip(texts, residue.shingle_sets(list(texts.values())))}
    want, front = set(), set(seeds)
    while front:
        front = {u for u in texts if u not in seeds | want and any(similar(sets[u], sets[v]) for v in front)}
        want |= front
    chain = set(range(601, 624))
    assert chain <= want and 100 < len(want) < 450
    found = spread_from(spark, texts, seeds)
    assert found <= want and len(found) >= 0.97 * len(want) and len(found & chain) >= 20
    monkeypatch.setattr(residue, "SLICE", 2)
    assert spread_from(spark, texts, seeds) == found


def test_recall_of_the_tables_at_all_sizes():
    """Pairs of similarity just over 0.8 share a key with FOUND probability, whatever the planned number of texts."""
    rng = np.random.default_rng(3)
    for n in (10**4, 10**7, 10**9):
        bits, tables = residue.table_plan(n)
        words = math.ceil(bits * tables / 64)
        hits, away = 0, []
        for _ in range(150):
            base = rng.integers(0, 2**63, 180).astype(np.uint64)
            a, b = np.unique(base[:162]), np.unique(base[18:])  # 144 of 180 in common
            x, y = (np.unpackbits(residue.simhash(s, words).view(np.uint8))[: bits * tables] for s in (a, b))
            hits += bool((x == y).reshape(tables, bits).all(axis=1).any())
            away.append((x != y).sum())
        assert hits >= 0.9 * 150
        most = (1 - residue.BIT_AGREES) * 64 * words + residue.SPARE * math.sqrt(residue.BIT_AGREES * (1 - residue.BIT_AGREES) * 64 * words)
        assert max(away) <= most


def test_unknown_wordings_are_found_by_spreading_alone(spark):
    """Long notices that no rule knows, near to one that is labelled by a rule, are found; the article is not."""
    notice = [f"notice{i}" for i in range(120)]
    known = "Internal Server Error\n" + "The server encountered an internal error. Please try again later. " * 3
    tail = " ".join(notice)
    texts = ["404 Not Found", known, tail + " quux", tail + " quuz", "An article about " + " ".join(f"thing{i}" for i in range(60)) + "."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = {r.doc_id: (r.kind, r.how) for r in residue.residue(docs).collect()}
    assert set(plain) == {0, 1} and plain[0] == ("error", "rule")
    plan = residue.table_plan(len(texts))
    marks = stage(residue.text_marks(docs, math.ceil(plan[0] * plan[1] / 64)).withColumn("kind", F.when(F.col("doc_id") == 2, "filler")))
    vids = {r.doc_id: r.vid for r in marks.collect()}
    assert [r.vid for r in residue.spread_labels(marks, docs, plan).collect()] == [vids[3]]


def test_furniture_and_markup_make_no_difference():
    a, b, c = residue.shingle_sets(["Bitte warten Sie auf den Dienst der Seite", "<div>BITTE warten Sie auf\nden Dienst der Seite</div>\n© archive", "一二三四五六七八"])
    assert (a == b).all() and len(c) == 4


def test_only_texts_with_a_shared_shingle_are_hashed(spark):
    """Of 300 articles only those near to the labelled text are read again; every pair at 0.8 or more shares a least shingle."""
    texts, _ = made(5)
    lone = {1000 + i: " ".join(f"x{i}y{j}" for j in range(60)) for i in range(300)}
    docs = spark.createDataFrame([*texts.items(), *lone.items()], "doc_id bigint, text string")
    marks = stage(residue.text_marks(docs))
    low = {r.doc_id: set(r.low) for r in marks.collect()}
    sets = {k: set(s.tolist()) for k, s in zip(texts, residue.shingle_sets(list(texts.values())))}
    assert all(low[a] & low[b] for a in range(0, 600, 4) for b in range(a + 1, a + 4) if similar(sets[a], sets[b]))
    front = marks.where("doc_id < 600 AND doc_id % 4 = 0")
    kept = {r.doc_id for r in residue._sharing(marks, front).select("doc_id").collect()}
    assert {k for k in low if any(low[k] & low[v] for v in range(0, 600, 4))} <= kept and len(kept & set(lone)) <= 3
