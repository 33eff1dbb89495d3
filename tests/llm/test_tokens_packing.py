import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noteflow.llm.packing import pack_counts, pack_items, tier_fill
from noteflow.llm.tokens import PairIndexEncoder, count_tokens, encode_corpus, read_vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoders():
    raw = read_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return PairIndexEncoder(raw), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ODD = ["", "a" * 5000, "ab" * 4000, "\n\n  x \t ", "　　a", "é" * 900, "<|endoftext|>", "\r\n\r\n x", "it's I'LL", "𝔉𝔯𝔞𝔨" * 50, "\x00\x01", "中文" * 300, "👩‍🚀"]


def test_odd_texts_match_the_library(encoders):
    mine, theirs = encoders
    assert mine.encode(ODD) == [theirs.encode_ordinary(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tab1'é中!.  ́​X"), max_size=60), max_size=4))
def test_any_text_matches_the_library(encoders, texts):
    mine, theirs = encoders
    assert mine.encode(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_a_full_cache_changes_nothing(encoders, monkeypatch):
    monkeypatch.setattr("noteflow.llm.tokens.CACHE_WORDS", 3)
    mine = PairIndexEncoder(read_vocabulary())
    for t in ["one two three four five", "six one seven", "one eight nine ten eleven"]:
        assert mine.encode([t]) == [encoders[1].encode_ordinary(t)]


def test_rows_of_the_corpus(spark, encoders):
    rows = [(1, "x y", "clash"), (1, "x y", "clash"), (2, None, None), (3, "", None), (None, "z", None), *[(10 + i, t, None) for i, t in enumerate(ODD)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id is None, r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()), key=str)
    assert got == sorted(((i is None, i, encoders[1].encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    counted = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert counted[2] == counted[3] == 0 and counted[1] == 2
    assert encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=30), st.sampled_from([1, 3, 5]))
def test_patterns_hold_every_piece(counts, tiers):
    patterns = pack_counts(dict(counts), 100, tiers)
    held = {}
    for pattern, n in patterns:
        assert n > 0 and sum(pattern) <= 100
        for s in pattern:
            held[s] = held.get(s, 0) + n
    assert held == counts
    used, total = sum(n for _, n in patterns), sum(s * n for s, n in counts.items())
    assert used <= 2 * -(-total // 100) + 1


def check_packing(out, sizes, capacity):
    containers, pieces = {}, {}
    for r in out:
        containers[r.container_no] = containers.get(r.container_no, 0) + r.n_tokens
        pieces.setdefault(r.key, []).append((r.piece_no, r.n_tokens))
    assert not containers or (max(containers.values()) <= capacity and sorted(containers) == list(range(len(containers))))
    for k, n in sizes.items():
        parts = [t for _, t in sorted(pieces.pop(k, []))]
        assert parts == ([capacity] * (n // capacity) + ([n % capacity] if n % capacity else []) if n > 0 else [])
    assert not pieces
    return len(containers)


@pytest.mark.parametrize("rank_rows", [250_000, 50])
def test_packing_is_whole_and_tight(spark, monkeypatch, rank_rows):
    monkeypatch.setattr("noteflow.llm.packing.RANK_ROWS", rank_rows)
    random.seed(2)
    sizes = {i: random.choice([random.randint(1, 30), random.randint(1, 400), 100, 33, random.randint(90, 110)]) for i in range(900)} | {1000: 0, 1001: -3, 1002: 1000}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()] + [(1003, None, "x")], "key bigint, n_tokens int, container_no string")
    used = check_packing(pack_items(df, "key", capacity=100, step=8).collect(), sizes, 100)
    assert used <= 1.02 * -(-sum(max(n, 0) for n in sizes.values()) // 100) + 1


def test_hot_size_and_steps_are_balanced(spark):
    df = spark.range(600).selectExpr("id key", "if(id % 3 = 0, 60, cast(id % 37 + 1 as int)) n_tokens")
    out = pack_items(df, "key", capacity=100, step=10).collect()
    check_packing(out, {r.key: r.n_tokens for r in df.collect()}, 100)
    steps = {}
    for r in out:
        steps[r.container_no // 10] = steps.get(r.container_no // 10, 0) + r.n_tokens
    full = [v for k, v in steps.items() if k < max(steps)]
    assert max(full) - min(full) <= 200


def test_tiers_matter_and_stay_tight():
    """Another number of tiers packs otherwise, and none needs over a twentieth more than the least possible
    containers."""
    random.seed(5)
    counts = {min(1800, 1 + int(random.expovariate(1 / 300))): random.randint(1, 9) for _ in range(500)}
    made = {t: pack_counts(counts, 1800, t) for t in (1, 2, 4, 6)}
    assert len({str(p) for p in made.values()}) == 4
    least = -(-sum(s * n for s, n in counts.items()) // 1800)
    assert all(sum(n for _, n in p) <= 1.05 * least for p in made.values())


def test_fill_of_each_tier(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([100, 60, 40, 50, 50, 30, 30, 30])], "key bigint, n_tokens int")
    out = {r.tier_tokens: (r.containers, r.pieces, r.tokens) for r in tier_fill(pack_items(df, "key", capacity=100, tiers=2), 100, 2).collect()}
    assert out == {100: (2, 3, 200), 50: (2, 5, 190)}


def test_packing_of_nothing(spark):
    assert pack_items(spark.createDataFrame([], "key bigint, n_tokens int"), "key").count() == 0


def test_equal_rows_are_items_of_their_own(spark):
    out = pack_items(spark.createDataFrame([(1, 60), (1, 60)], "key bigint, n_tokens int"), "key", capacity=100).collect()
    assert sorted(r.container_no for r in out) == [0, 1]
