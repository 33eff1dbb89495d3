"""Small cases with known results: the safety filter of several hops, paths under a bound of hops, cited spans, model output."""

import pytest
from pyspark.sql import functions as F

from noteflow.operators import graph, hybrid, paths, planning, relating
from noteflow.operators.references import latest


def test_multihop_safety_saves_the_first_document(spark):
    rows = [("n1", "doc1", 0.9, 1, "note 1"), ("n2", "doc2", 0.6, 2, "plain"), ("n5", "doc5", 0.55, 2, "plain"), ("n3", "doc3", 0.2, 2, "contains bridge"), ("n4", "doc_missing", 0.1, 2, "bridge")]
    df = spark.createDataFrame([("q", c, t, s, h, b, ["bridge"]) for c, t, s, h, b in rows], "query string, candidate string, title string, final double, hop_no int, blob string, path array<string>")
    out = hybrid.multihop_safety(df, keep=1, tail=0.3, first_doc="doc_missing").orderBy(F.desc("final")).collect()
    assert [r.candidate for r in out] == ["n1", "n2", "n4"] and out[-1].saved


@pytest.mark.parametrize(("hops", "longest"), [(1, 2), (2, 3), (3, 4)])
def test_paths_keep_the_bound_of_hops(spark, hops, longest):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0)], "src string, dst string, weight double")
    p = graph.simple_paths(graph.undirected(e), spark.createDataFrame([("A",)], "node string"), hops).collect()
    assert max(len(r.path) for r in p) == longest and ["A", "B"] in [r.path for r in p]


def test_cited_spans(spark):
    rows = [
        ("ok", "{}", ["[L2] Steve Hillage is a musician."], ["Alice married Bob in 1999.", "Steve Hillage is a musician."], True, "Steve Hillage"),
        ("none", "{}", [], ["Phylicia Rashād is the former spouse of Victor Willis."], False, None),
        ("other", "{}", ["[L1] Grant Green recorded an album in 1971."], ["Grant Green recorded an album in 1971."], True, "Steve Hillage"),
        ("nobody", "{}", ["[L1] Grant Green recorded"], ["Grant Green recorded an album in 1971."], True, " "),
        ("text", None, None, None, None, None), ("line", "{}", ["[L7] Grant Green", "L1 Grant"], ["Grant Green"], False, None),
    ]
    df = spark.createDataFrame(rows, "id string, json string, spans array<string>, lines array<string>, used_candidate boolean, candidate string")
    got = {r.id: (r.n_valid, r.error) for r in planning.checked_spans(df).collect()}
    assert got == {"ok": (1, None), "none": (0, "no_valid_evidence_spans"), "other": (1, "used_candidate_not_supported_by_spans"), "nobody": (1, "used_candidate_without_candidate_answer"),
                   "text": (0, "json_parse_failed"), "line": (0, "no_valid_evidence_spans")}


def test_notes_in_model_output(spark):
    one = '{"text": " A note. ", "sent_count": null, "salience": 1.7, "source_sent_ids": ["3", 1, "x", 3]}'
    raw = [("a", f"[{one}]"), ("b", one), ("c", f"Here you are: [{one}]"), ("d", f"Well, {one} it is"), ("e", "~"), ("f", None), ("g", "[]"), ("h", "no notes today")]
    df = spark.createDataFrame(raw, "id string, raw string")
    out = planning.parsed_notes(df, "id", "raw")
    got = {r.id: r.state for r in out.collect()}
    assert got == dict.fromkeys("abcd", "notes") | dict.fromkeys("efg", "empty") | {"h": "failed"}
    n = out.where("id = 'a'").select(planning.normalized_note(F.col("notes")[0]).alias("n")).first().n
    assert (n.text, n.sent_count, n.salience, list(n.source_sent_ids), list(n.entities)) == ("A note.", 1, 1.0, [1, 3], [])


def test_answers_in_model_output(spark):
    df = spark.createDataFrame([("a", '{"answer": "Fennick", "support_idxs": [9, 1, "1"]}'), ("b", '```json\n{"answer": "Brask", "support_idxs": [0]}\n```'), ("c", '"{\\"answer\\": \\"Fennick\\"}"'), ("d", '{"answer": " "}'), ("e", '{"answer": "Unknown"}'), ("f", "Fennick"), ("g", None)], "id string, raw string")
    p = spark.createDataFrame([(k, i, t) for k in "abcdefg" for i, t in ((0, "Born in Fennick."), (1, "Lives in Fennick."), (2, "Left for Brask."))], "id string, idx int, paragraph_text string")
    got = {r.id: (r.state, r.answer, r.support and list(r.support)) for r in planning.checked_answers(df, p, "id", "raw").collect()}
    assert got == {"a": ("ok", "Fennick", [1]), "b": ("ok", "Brask", [2]), "c": ("ok", "Fennick", [0]), "d": ("empty", None, None), "e": ("forbidden", None, None), "f": ("no_json", None, None), "g": ("no_json", None, None)}


def test_hints_and_listed_questions(spark):
    df = spark.createDataFrame([("a", "Ada", 0.9, ["ada", "Bob", "Cy"]), ("b", "Ada", 0.5, ["Bob", None, " "]), ("c", None, None, None)], "id string, answer string, score double, others array<string>")
    hint = planning.answer_hint(F.col("answer"), F.col("score"), F.col("others"))
    assert {r.id: r.h for r in df.select("id", hint.alias("h")).collect()} == {"a": "Ada | Bob", "b": "Bob", "c": None}
    text = spark.createDataFrame([('1. Who was it?\n- Where is it?\n"When was it?"',)], "t string")
    assert text.select(planning.listed_questions(F.col("t")).alias("q")).first().q == ["When was it?", "Who was it?", "Where is it?"]


def test_person_rules_and_namespace(spark):
    df = spark.createDataFrame([("a", [("Ada Vance left.", ["Ada"]), ("Nobody came.", ["Bob"])]), ("b", [("Ada left.", ["Ada"])]), ("c", [("Ada left.", None)])], "id string, notes array<struct<content: string, persons: array<string>>>")
    assert {r.id: (r.person_coverage, r.valid) for r in planning.person_rules(df).collect()} == {"a": (0.5, False), "b": (1.0, True), "c": (0.0, False)}
    n = spark.createDataFrame([("x", ("C:\\Data\\Mill\\q7.json", "q7.json", "h"))], "note_id string, source_info struct<file_path: string, file_name: string, file_hash: string>")
    assert planning.require_namespace(n, "data", "Q7").count() == 1
    with pytest.raises(ValueError):
        planning.require_namespace(n, "data", "q8")


def test_rows_with_null_keys_stay_apart(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 1, "c"), ("k", 2, "d"), ("k", None, "e")], "key string, ingested_at int, v string")
    assert sorted(r.v for r in latest(df, ["key"]).collect()) == ["a", "b", "d"]


def test_diverse_paths_and_degrees(spark):
    s = spark.createDataFrame([("s", "A>B>C", 0.9), ("s", "A>B>D", 0.8), ("s", "X>Y", 0.5)], "seed string, path_id string, score double")
    assert [r.path_id for r in paths.diverse_paths(s).orderBy("place").collect()] == ["A>B>C", "X>Y"]
    assert [r.path_id for r in paths.penalized_paths(s, 2).orderBy("place").collect()] == ["A>B>C", "A>B>D"]
    r = spark.createDataFrame([(f"r{i}", "hub", f"n{i}", 1.0 - i / 100) for i in range(15)], "relation_id string, source_id string, target_id string, weight double")
    assert [x.relation_id for x in paths.degree_limited(r).orderBy("place").collect()] == [f"r{i}" for i in range(11)]


def test_spouses_join_the_notes_of_both_names(spark):
    rows = [("a", "Ada Vance is married to Bob Quill.", ["Ada Vance"]), ("b", "A note on the mill.", ["Bob Quill", None]), ("c", "Cy Marl's wife Dot Marl left. 'Ada Vance's husband Bob Quill' is a song.", ["Dot Marl"]), ("d", None, None)]
    n = spark.createDataFrame(rows, "note_id string, content string, entities array<string>")
    assert {(r.source_id, r.target_id, r.name_a, r.name_b) for r in relating.spouse_relations(n).collect()} == {("a", "b", "Ada Vance", "Bob Quill")}
