import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from noteflow.functions.runtime import stage
from noteflow.llm import names, pairs, registry, residue


def entities(spark, spelled, entries=()):
    n = spark.createDataFrame([(x,) for x in spelled], "name string")
    e = spark.createDataFrame(list(entries), "entry bigint, name string")
    return {r.name: r.entity for r in names.link_names(n, e).collect()}


def test_variants_of_persons_and_organisations(spark):
    person = ["Robert Zekokeistus", "ZEKOKEISTUS, Robert", "Zekokeistus Robert", "robert  zekokeistus", 'Robert "Bob" Zekokeistus', "Bob Zekokeistus", "Dr. Robert Zekokeistus",
              "Roebrt Zekokeistus", "Robert Zekokesitus", "R. Zekokeistus", "Zekokeistus R", "Robert K. Zekok0istus"]
    other = ["Inés Zekokeistus", "Ines Zekokeistus"]
    bank = ["First Bank of Sovostaiskounwick", "FIRST BANK OF SOVOSTAISKOUNWICK", "1st Bank of Sovostaiskounwick", "First Bk. Sovostaiskounwick", "Bank of Sovostaiskounwick, First", "FB Sovostaiskounwick"]
    second = ["Second Bank of Sovostaiskounwick", "2nd Bank of Sovostaiskounwik"]
    got = entities(spark, [*person, *other, *bank, *second, "Velmora", None, "", "  "])
    for group in (person, other, bank, second):
        assert len({got.get(x, x) for x in group}) == 1, {x: got.get(x) for x in group}
    assert len({got[g[0]] for g in (person, other, bank, second)}) == 4
    assert "Velmora" not in got and "" not in got


def test_ambiguous_initials_need_an_entry(spark):
    base = ["Robert Hustasubar", "Rosalind Hustasubar", "R. Hustasubar"]
    assert "R. Hustasubar" not in entities(spark, base)
    got = entities(spark, base, [(1, "R. Hustasubar"), (1, "Rosalind Hustasubar")])
    assert got["R. Hustasubar"] == got["Rosalind Hustasubar"]


def test_order_alone_is_no_difference(spark):
    """Short surnames and heads that no list has."""
    e = entities(spark, ["Robert Lee", "Lee, Robert", "Maria Li", "Li, Maria", "Zekokeistus Observatory", "Observatory of Zekokeistus", "Quell Point", "Point Quell", "Ada Vance"])
    same = [("Robert Lee", "Lee, Robert"), ("Maria Li", "Li, Maria"), ("Zekokeistus Observatory", "Observatory of Zekokeistus"), ("Quell Point", "Point Quell")]
    assert all(e[a] == e[b] for a, b in same) and len({e[a] for a, _ in same} | {e["Ada Vance"]}) == 5


def test_other_people_stay_apart(spark):
    """Further names must agree, and surnames that several people bear are not taken for misspellings of each other."""
    e = entities(spark, ["Robert Smith Jones", "Robert Jones", "Robert Price Jones", "Jones, Robert Price"])
    assert e["Robert Price Jones"] == e["Jones, Robert Price"] and len(set(e.values())) == 3
    people = [f"{g} {s}" for s, gs in {"Anderson": ["Robert", "Mary", "John", "Sarah"], "Andersen": ["Robert", "Peter", "Anne"]}.items() for g in gs]
    e = entities(spark, [*people, "Mary Andreson"])
    assert e["Robert Anderson"] != e["Robert Andersen"] and e["Mary Andreson"] == e["Mary Anderson"]


def test_given_names_and_heads_are_learned(spark):
    surnames = ["Kestrapol", "Dunwiddel", "Marfolane", "Ostrevik"]
    e = entities(spark, [f"Ozwilda {s}" for s in surnames] + ["Kestrapol Ozwilda", "Ozwlida Dunwiddel", "Observatory of Kestrap", "Observatory of Dunwid", "Observatory of Marfol", "Kestrap Observatroy"])
    assert e["Ozwilda Kestrapol"] == e["Kestrapol Ozwilda"] and e["Ozwilda Dunwiddel"] == e["Ozwlida Dunwiddel"]
    assert e["Observatory of Kestrap"] == e["Kestrap Observatroy"] and len(set(e.values())) == 7


def test_whole_names_match_in_every_order(spark):
    def frame(forms):
        return spark.createDataFrame([(f,) for f in forms], "form string")

    got = {tuple(r) for r in names.whole_matches(frame(["cedar green lodge", "bay tessaly"]), frame(["cedar lodgee green", "bay tesaly", "bay tessaly", "bay vessel", "cedar green"])).collect()}
    assert got == {("cedar green lodge", "cedar lodgee green"), ("bay tessaly", "bay tesaly")}


def test_no_names(spark):
    assert entities(spark, []) == {}


def test_trie_join_matches_brute_force(spark):
    random.seed(4)
    base = ["".join(random.choice("aeioukstr") for _ in range(random.randint(4, 13))) for _ in range(60)]

    def typo(w):
        i = random.randrange(len(w))
        return random.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    words = sorted({*base, *(typo(w) for w in base), *(typo(typo(w)) for w in base)})
    got = {tuple(r) for r in names.trie_join(spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    want = {(a, b) for a, b in itertools.permutations(words, 2) if names.edits(a, b, 2) <= max(names.reach(a), names.reach(b))}
    assert got == want


def test_trie_walk_matches_edits():
    random.seed(6)
    words = ["".join(random.choice("abc") for _ in range(random.randint(0, 7))) for _ in range(120)]
    trie = names.Trie(words)
    for w in words[:40]:
        assert sorted(set(trie.near(w, 2))) == sorted({v for v in words if names.edits(w, v, 2) <= 2})


def test_label_model_finds_the_classes():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.06
    votes = np.stack([np.where(rng.random(len(y)) < 0.25, 0, np.where(y == (rng.random(len(y)) < a), 1, -1)) for a in (0.97, 0.95, 0.93, 0.9)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = pairs.LabelModel(patterns, counts.astype(float))
    p = np.array([model.posterior[tuple(v)] for v in votes.tolist()])
    assert ((p > 0.5) == y).mean() > 0.99
    assert ((votes.sum(axis=1) > 0) == y).mean() < ((p > 0.5) == y).mean()
    assert 0.1 <= pairs.best_cutoff(p, y.astype(float), np.ones(len(y))) <= 0.9


def test_label_models_beat_majority_votes_on_planted_pairs(spark):
    """On planted pairs that neither fit nor cutoff saw, the model is as good as the majority for every defect, and on average much better;
    defects count as often as the model says they are among all pairs."""
    q = spark.read.parquet("/root/testdata/sf0.1/qa_results.parquet").select("id", "question", "predicted_answer").dropDuplicates(["id"]).orderBy("id").collect()
    lm = pairs.fit_language(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    votes = [(r.question, r.predicted_answer, pairs._votes(r.question, r.predicted_answer, lm)) for r in q]
    sound = [(str(i), a, b) for i, (a, b, v) in enumerate(votes) if a and b and all(sum(x == 1 for x in v[d][:n]) < m for d, (n, m) in pairs.SUSPECT.items())]
    planted = [(kind, pairs._votes(a, b, lm)) for _, a, b, kind in pairs.plant(sound, lm)]
    f1 = lambda chosen, y, w: 2 * w[chosen & y].sum() / max(w[chosen].sum() + w[y].sum(), 1e-9)
    gain = 0.0
    for d in pairs.DEFECTS:
        patterns, counts = np.unique(np.array([v[d] for *_, v in votes]), axis=0, return_counts=True)
        mine = [(tuple(v[d]), int(kind == d)) for kind, v in planted if kind in (d, None)]
        model = pairs.LabelModel(patterns, counts.astype(float), [(v, y, 1.0) for v, y in mine[::3]])
        (seen, known), (held, y) = ((np.array([v for v, _ in part]), np.array([bool(label) for _, label in part])) for part in (mine[1::3], mine[2::3]))
        weigh = lambda y: np.where(y, model.prior / (1 - model.prior) * (~y).sum() / y.sum(), 1.0)  # noqa: B023, E731
        cutoff = pairs.best_cutoff(model.posteriors(seen), known.astype(float), weigh(known))
        fitted, majority = f1(model.posteriors(held) >= cutoff, y, weigh(y)), f1(held.sum(axis=1) > 0, y, weigh(y))
        assert fitted >= majority - 0.02, (d, fitted, majority)  # a pair or two of some fifty
        gain += (fitted - majority) / len(pairs.DEFECTS)
    assert gain > 0.1


def test_rows_and_labels_are_kept(spark):
    """Null and repeated keys stay rows of their own, and a pair may have several labels."""
    q = spark.read.parquet("/root/testdata/sf0.1/qa_results.parquet").select("id", "question", "predicted_answer")
    asked = "Why did the founder leave the town of Fennick?"
    mine = [(None, asked, "I'm sorry, but I cannot answer this question."), (None, asked, ""), ("k", asked, None), ("k", asked, None), ("m", asked, "Der Rat lehnte die Verlängerung ab, daher konnte sie nicht bleiben und ging mit ihren Kindern in die")]
    out = pairs.label_pairs(q.where("id IS NOT NULL").union(spark.createDataFrame(mine, q.schema)), spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    got = [(r.id, sorted(x.defect for x in r.labels)) for r in out.where("id IS NULL OR id IN ('k', 'm')").collect()]
    assert sorted(got, key=str) == sorted([(None, ["refusal"]), (None, ["empty"]), ("k", ["empty"]), ("k", ["empty"]), ("m", ["other_language", "truncated"])], key=str)


@pytest.fixture(scope="module")
def defects(spark):
    q = spark.read.parquet("/root/testdata/sf0.1/qa_results.parquet").select("id", "question", "predicted_answer")
    planted = [
        ("e1", "Who founded the mill?", None), ("e2", "Who founded the mill?", " ​"), ("e3", "Who founded the mill?", "N/A"), ("e4", "Who founded the mill?", "Answer:"),
        ("r1", "Who founded the mill?", "I'm sorry, but I cannot answer this question."), ("r2", "Who founded the mill?", "The passages never mention it, so I will leave the field blank."),
        ("c1", "Who founded the old mill?", "Who founded the old mill"), ("c2", "Who founded the old mill?", "You asked: who founded the old mill?"),
        ("l1", "Why did she leave the town?", "Der Rat lehnte die Verlängerung ab, daher konnte sie nicht bleiben und ging fort."), ("l2", "Why did she leave the town?", "因为议会拒绝延长许可，因此她无法留下。"),
        ("t1", "Why did she leave the town?", "The council refused to renew the licence, so she was unab"), ("t2", "Why did she leave the town?", "The council refused to renew the licence, and the"),
        ("s1", "Where was she born?", "Fennick"), ("s2", "Which song topped the list?", "Sorry, I Can't Stay"), ("s3", "What is the word?", '"Unknown"'), ("s4", None, "Fennick"), ("s5", "How many?", "12"),
        ("s6", "Where was she born?", 'As to the question "Where was she born?": She was born in Fennick, a town known for its market.'),
        ("s7", "What is the motto of the town?", '"Nous restons ici"'), ("x1", "Why did she leave the town?", "The council said no. " * 3000),
    ]
    df = q.union(spark.createDataFrame(planted, q.schema))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return {r.id: r.defect for r in pairs.main_defect(pairs.label_pairs(df, docs)).collect()}


@pytest.mark.parametrize(("ids", "defect"), [("e1 e2 e3 e4", "empty"), ("r1 r2", "refusal"), ("c1 c2", "copies_question"), ("l1 l2", "other_language"), ("t1 t2", "truncated"), ("s1 s2 s3 s4 s5 s6 s7 x1", None)])
def test_planted_pairs(defects, ids, defect):
    assert {i: defects.get(i) for i in ids.split()} == dict.fromkeys(ids.split(), defect)


def test_no_pairs(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert pairs.label_pairs(spark.createDataFrame([], "id string, question string, predicted_answer string"), docs).count() == 0


PROSE = "The harbour of the town was opened to the public in 1721 and draws about two hundred visitors a year. The founder's portrait shows her beside a canal."


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (None, None), ("", None), (" \n", None), ("?", None), ("Fennick", None), ("<|endoftext|>", None), (PROSE, None), ("The set {1, 2, 3} and its images [12] cost $4,500, 12% more. The sign read <NORTH> and [closed].", None),
        (PROSE + " The archive was rewritten so that it works without JavaScript.", None), ("See Notes on a Silver Festival.", None), ("<b>" + PROSE + "</b>", None),
        (PROSE.replace("canal", "{{ author }}"), "field"), ("Dear %TITLE%, thank you.", "field"), ("[INSERT TITLE HERE]", "field"), ("Born: <year>", "field"), ("__NAME__ was here", "field"),
        ("Please enable JavaScript to view this page.", "script"), ("Skip to content\nTo read on, allow scripts and reload!", "script"), ("Bitte aktivieren Sie JavaScript, um diesen Inhalt anzuzeigen.", "script"),
        ("Error 404 - Not Found", "error"), ("<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1></body></html>", "error"), ("Something went wrong on our end. Please try again later.", "error"), ("La page demandée est introuvable. Retour à l'accueil.", "error"),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("Title\n\nThis is sample text. Replace it with your own content.", "filler"), ("Text text text text text. Text text text text.", "filler"),
    ],
)
def test_kinds_of_text(text, kind):
    assert residue.kind_of(text) == kind


def test_labels_spread_to_near_copies_only(spark):
    words = [f"word{i}" for i in range(80)]
    seed, near, far = " ".join(words), " ".join(words[:79] + ["other"]), " ".join(reversed(words))
    chain = " ".join(words[:77] + ["other", "third", "fourth"])
    docs = spark.createDataFrame([(1, seed), (2, near), (3, far), (4, near), (5, chain), (6, None), (7, "")], "doc_id bigint, text string")
    marks = stage(residue.text_marks(docs, 10).withColumn("kind", F.when(F.col("doc_id") == 1, "error")))
    ids = {}
    for r in marks.collect():
        ids.setdefault(r.vid, set()).add(r.doc_id)
    got = residue.spread_labels(marks, docs, (8, 80)).collect()
    assert set().union(*[ids[r.vid] for r in got]) == {2, 4, 5}


def test_residue_rows(spark):
    rows = [(1, "Please enable JavaScript to view this page."), (2, PROSE), (1, "Please enable JavaScript to view this page."), (None, "Error 404 - Not Found"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kind string")
    assert sorted((r.doc_id or 0, r.kind) for r in residue.residue(df).collect()) == [(0, "error"), (1, "script"), (1, "script")]
    assert residue.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_queries_survive_empty_tables(spark, tmp_path):
    for f in ("atomic_notes", "qa_results", "documents", "note_embeddings", "alias_entries"):
        spark.read.parquet(f"/root/testdata/sf0.001/{f}.parquet").limit(0).write.parquet(f"{tmp_path}/{f}.parquet")
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "p7_fill" else 0), name


def test_models_see_every_pair_and_document(spark, monkeypatch):
    """Defects are planted into each calm pair, however many groups there are, and each document's words count."""
    monkeypatch.setattr(pairs, "PLANTED_ROWS", 10)
    docs = spark.createDataFrame([(i, f"stem word{i} " + "the house stood there " * 6, "en") for i in range(1200)], "doc_id bigint, text string, lang string")
    lm = pairs.fit_language(docs)
    assert all(f"word{i}" in lm.known for i in range(1200))
    rows = [(str(i), f"Who built the bridge number {i}?", f"The bridge number {i} was built by the masons of the northern town in the year {1500 + i}.") for i in range(160)]
    voted = spark.createDataFrame([(*r, *pairs._votes(r[1], r[2], lm).values()) for r in rows], "k string, q string, a string, " + ", ".join(f"{d} array<int>" for d in pairs._votes("", "", lm)))
    made = pairs._planted(voted, spark.sparkContext.broadcast(lm)).where("label = 0 AND defect = 'empty'").toPandas()
    assert made.n.sum() >= 30  # up to three of eight stay as they are, in every group; of ten pairs it would be three


def test_long_names_with_a_misspelling_that_moves_a_word_inside(spark):
    """Two misspelt words may stand anywhere in the alphabetical order."""
    whole = "almond bridge castle driver zephyr"
    others = ["almond bridge castle qephyr driver", "almond pridge castle driver zephyr", "almond pridge castle driver qephyr", "alpine pridge castle driver zephyr"]
    forms = [" ".join(sorted(x.split())) for x in others]
    found = names.whole_matches(spark.createDataFrame([(whole,)], "form string"), spark.createDataFrame([(x,) for x in [whole, *forms]], "form string"))
    assert {r.other for r in found.collect()} == set(forms[:3])
