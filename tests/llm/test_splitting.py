import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noteflow.llm.splitting import split_items, split_text

ALPHABET = st.sampled_from("ab, .\n。中é—" + "x" * 6)


def check(text, pieces, limit, overlap):
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert 0 < p.end - p.start <= limit or not text
    for a, b in zip(pieces[:-1], pieces[1:]):
        assert b.start == a.end - overlap and b.end > a.end
    for p in pieces[:-1]:
        last = text[p.end - 1]
        if p.kind == "boundary":
            assert last.isspace() or not last.isalnum()
        else:
            assert p.kind == "forced" and text[p.start + overlap : p.end].isalnum()
    assert pieces[-1].kind == "end"


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=600), st.sampled_from([(40, 5), (40, 0), (60, 30), (20, 19)]))
def test_pieces_cover_the_text(text, shape):
    check(text, split_text(text, *shape), *shape)


def test_long_and_solid_texts():
    check("x" * 20_000, split_text("x" * 20_000), 512, 50)
    sentence = "A sentence of some words. " * 4000
    pieces = split_text(sentence)
    check(sentence, pieces, 512, 50)
    assert all(sentence[: p.end].endswith(". ") for p in pieces[:-1])


def test_pieces_are_balanced():
    lengths = [p.end - p.start for p in split_text("word " * 250)]
    assert max(lengths) - min(lengths) < 30


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        split_text("x", 10, 10)


def test_rows(spark):
    solid, prose = "y" * 600, "Some words here. " * 60
    rows = [("a", 3, solid, 1), ("b", 0, prose, 1), ("c", 1, "short", 1), ("d", 1, None, 1), ("e", 1, "", 1), (None, 2, prose, 1), ("f", None, "z" * 512, 1), ("g", 5, "𝔉" * 513, 1)]
    df = spark.createDataFrame(rows, "note_id string, chunk_index int, original_text string, piece int")
    out = split_items(df, "note_id", "original_text", ["chunk_index"]).collect()
    first = {r.note_id: (r.chunk_index, r.cut) for r in out if r.piece_no == 0}
    assert first == {"a": (3, "forced"), "b": (0, "boundary"), None: (2, "boundary"), "g": (5, "forced")}
    b = sorted((r for r in out if r.note_id == "b"), key=lambda r: r.piece_no)
    assert b[0].piece + "".join(r.piece[50:] for r in b[1:]) == prose
    assert split_items(df.limit(0), "note_id", "original_text").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_forced_pieces_and_solid_runs_agree(spark, sf):
    """A note is marked as forced by its text exactly where some of its pieces had to be cut at the limit."""
    n = spark.read.parquet(f"/root/testdata/{sf}/atomic_notes.parquet").dropDuplicates(["note_id"])
    out = split_items(n, "note_id", "original_text").collect()
    told = {r.note_id for r in out if r.cut == "forced"}
    assert told == {r.note_id for r in out if r.end_kind == "forced"} and len({r.note_id for r in out}) > len(told) > 0


def test_natural_cuts_are_found_where_targets_miss_them():
    """Boundaries far from every equal-length target still serve."""
    text = ("y" * 505 + ". ") + ("z" * 440 + ". ") * 3 + "w" * 450
    pieces = split_text(text)
    check(text, pieces, 512, 50)
    assert all(p.kind == "boundary" for p in pieces[:-1])
