import itertools
import random

from noteflow.functions.runtime import stage
from noteflow.operators import reasoning, selection

SCHEMA = "query string, candidate int, score double, text string, paths array<string>"


def picked(spark, make, rows):
    out = {}
    for r in make(spark.createDataFrame(rows, SCHEMA)).orderBy("query", "place").collect():
        out.setdefault(r.query, []).append(r.candidate)
    return out


ROWS = [("q", 1, 0.9, "a b c d", ["p"]), ("q", 2, 0.8, "a b c d", ["p"]), ("q", 3, 0.5, "x y", ["r"]), ("q", 4, 0.5, None, None), ("z", 9, 0.1, "", [])]


def test_mmr_prefers_new_words(spark):
    assert picked(spark, lambda d: selection.mmr(d, 2, 0.5), ROWS) == {"q": [1, 3], "z": [9]}


def test_diverse_starts_with_the_best(spark):
    got = picked(spark, lambda d: selection.diverse(d, 3), ROWS)
    assert got["q"][0] == 1 and set(got["q"]) == {1, 3, 4}


def test_budget_and_gain(spark):
    assert picked(spark, lambda d: selection.within_budget(d, 120), ROWS) == {"q": [1, 2]}
    assert picked(spark, lambda d: selection.within_budget(d, 40), ROWS) == {}


def test_near_copies_are_suppressed(spark):
    assert picked(spark, lambda d: selection.suppress_near(d), ROWS)["q"] == [1, 3, 4]
    assert picked(spark, lambda d: selection.suppress_near(d, keep=2), ROWS)["q"] == [1, 2, 3, 4]


def test_paths_are_covered(spark):
    assert picked(spark, lambda d: selection.cover_paths(d, 1), ROWS)["q"] == [1, 3]


def test_nothing_to_select(spark):
    assert picked(spark, selection.mmr, []) == {}


def test_similarity_join_matches_all_pairs(spark):
    random.seed(8)
    words = ["w1", "w2", "w3"]
    rows = []
    for i in range(120):
        base = random.sample([f"w{j}" for j in range(40)], random.randint(1, 12)) if i % 3 else list(words)
        words = base[:-1] + ["new"] if random.random() < 0.5 else base
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, " ")]
    df = spark.createDataFrame(rows, "id int, text string")
    members, sets = selection.word_sets(df, "id", "text")
    s = {r.sid: set(r.s) for r in sets.collect()}
    got = {(r.a, r.b) for r in selection.similar_sets(sets, 0.6).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(s, 2) if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    out = {r.id: r for r in selection.lexical_duplicates(df, "id", "text", 0.6).collect()}
    of = {r.id: r.sid for r in members.collect()}
    assert all(out[i].links == sum(of[i] in p for p in got) for i in out) and 200 not in out
    assert all(out[i].class_id == out[j].class_id for i in out for j in out if of[i] == of[j])


def test_beam_keeps_the_best_paths(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("b", "d", 0.1), ("c", "d", 0.9), ("d", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = [(tuple(r.path), r.score) for r in reasoning.beam_search(e, seeds, 2, beam=1).collect()]
    assert sorted(got) == [(("a", "b"), 0.9), (("a", "b", "d"), 1.0)]
    wide = {tuple(r.path): r.score for r in reasoning.beam_search(e, seeds, 2, beam=4).collect()}
    assert wide[("a", "c", "d")] == 1.4


def test_hops_between_passages(spark):
    a = spark.createDataFrame([("i", 0, 2), ("j", 0, 0), ("k", 1, None), ("l", 0, 9)], "id string, question_idx int, answer_idx int")
    g = spark.createDataFrame([("i", 0, 1, 0.5), ("i", 1, 2, 0.5)], "item_id string, a int, b int, weight double")
    assert dict(reasoning.hops_needed(a, g).collect()) == {"i": 3, "j": 2, "k": 2, "l": 4}


def test_similar_sets_of_all_sizes_meet_and_others_do_not(spark, monkeypatch):
    """All pairs of short and long sets, by brute force; sets that share rare words without being similar make no pairs to verify."""
    random.seed(5)
    base = [[f"b{i}w{j}" for j in range(n)] for i, n in enumerate([6, 7, 12, 13, 16, 20, 25, 40, 120])]
    rows = [" ".join([*b[: len(b) - cut], *(f"z{cut}{j}" for j in range(add))]) for b in base for cut in range(0, len(b) // 6 + 2, max(1, len(b) // 20)) for add in range(min(4, len(b) // 6 + 2))]
    rows += [f"place{i % 20} year{i % 20} town{i % 20} " + " ".join(random.sample([f"often{j}" for j in range(40)], 13)) for i in range(300)]
    _, sets = selection.word_sets(spark.createDataFrame(list(enumerate(rows)), "id int, text string"), "id", "text")
    written = {}
    monkeypatch.setattr(selection, "stage", lambda df, name="stage": written.setdefault(name, stage(df, name)))
    s = {r.sid: set(r.s) for r in sets.collect()}
    got = {(r.a, r.b): r.similarity for r in selection.similar_sets(sets, 0.85).collect()}
    assert set(got) == {(a, b) for a, b in itertools.combinations(sorted(s), 2) if round(len(s[a] & s[b]) / len(s[a] | s[b]), 9) >= 0.85}
    assert written["set-pairs"].count() < len(got) + 300
