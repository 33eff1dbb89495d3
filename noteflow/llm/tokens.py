"""Problem 6: token ids of a whole corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern; the words new to a task are encoded together through an index
from each mergeable pair to all its positions. The active ranks are applied in ascending order, each at all its
positions at once, and only the pairs beside a merge are looked up again. One very long word costs n log n, not n^2.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions.runtime import spread, table

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the word pattern this vocabulary was made with.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of new words that are indexed together, words kept between batches, characters of text handled at once.
INDEX_BYTES, CACHE_WORDS, SLICE_CHARS = 1 << 20, 400_000, 1 << 22


class PairIndexEncoder:
    """Encodes words with ranks {bytes: id}; a merge makes the token whose bytes are those of both parts."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        two = np.full((256, 256), -1, np.int64)
        for b, i in self.ranks.items():
            if len(b) == 2:
                two[b[0], b[1]] = i
        self.two = two
        self.pairs: dict[int, int] = {}
        self.cache: dict[str, list[int]] = {}
        self.words = regex.compile(WORD_PATTERN).findall

    def _pair(self, a: int, b: int) -> int:
        """Id of the token that a and b merge to, or -1."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return got

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        raw = [w.encode() for w in words]
        if not raw:
            return []
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        n = len(flat)
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[ends] = True  # a position that begins a word, and the end
        made = self.two[flat[:-1], flat[1:]] if n > 1 else np.zeros(0, np.int64)
        made = np.where(first[1:n], -1, made)
        at = np.flatnonzero(made >= 0)
        at = at[np.argsort(made[at], kind="stable")]
        tokens, starts = np.unique(made[at], return_index=True)
        places = {int(t): p.tolist() for t, p in zip(tokens, np.split(at, starts[1:]), strict=True)} if len(at) else {}
        active = list(places)
        heapq.heapify(active)
        sym = self.byte_ids[flat].tolist()
        after = np.where(first[1:], -1, np.arange(1, n + 1)).tolist()
        before = np.where(first[:n], -1, np.arange(-1, n - 1)).tolist()
        pair = self._pair
        while active:
            token = heapq.heappop(active)
            for p in sorted(places.pop(token)):
                a = sym[p]
                q = after[p] if a >= 0 else -1
                if q < 0 or pair(a, sym[q]) != token:
                    continue  # one of its parts went into another merge
                sym[p], sym[q] = token, -1
                right = after[p] = after[q]
                left = before[p]
                if right >= 0:
                    before[right] = p
                    t = pair(token, sym[right])
                    if t >= 0:
                        if t in places:
                            places[t].append(p)
                        else:
                            places[t] = [p]
                            heapq.heappush(active, t)
                if left >= 0:
                    t = pair(sym[left], token)
                    if t >= 0:
                        if t in places:
                            places[t].append(left)
                        else:
                            places[t] = [left]
                            heapq.heappush(active, t)
        out = np.array(sym, np.int64)
        kept = np.concatenate([[0], np.cumsum(out >= 0)])[np.concatenate([[0], ends])].tolist()
        ids = out[out >= 0].tolist()
        return [ids[a:b] for a, b in zip(kept[:-1], kept[1:], strict=True)]

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        batch, size = [], 0
        for w in words:
            batch.append(w)
            size += 4 * len(w)
            if size > INDEX_BYTES:
                self.cache.update(zip(batch, self.encode_words(batch), strict=True))
                batch, size = [], 0
        self.cache.update(zip(batch, self.encode_words(batch), strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; null and empty texts have none."""
        split = [self.words(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(split))
        known = self.cache
        missing = wanted - known.keys()
        if missing:
            if len(known) > CACHE_WORDS:
                missing = wanted
            self._learn(missing)
        get = known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


def read_vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver and sent with the tasks (its size does not depend on the data)."""
    return Path(path or f"{TOKENIZER_DIR}/{VOCABULARY}").read_bytes()


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of about SLICE_CHARS characters, with their texts."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE_CHARS or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def _mapper(shared, column: str, keep: list[str], make: Callable[[list[list[int]]], tuple[str, pa.Array]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(shared.value)
        for batch in batches:
            for part, texts in _slices(batch, column):
                name, made = make(encoder.encode(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], made], [*keep, name])

    return run


def _id_lists(ids: list[list[int]]) -> tuple[str, pa.Array]:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
    return "ids", pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _counts(ids: list[list[int]]) -> tuple[str, pa.Array]:
    return "n_tokens", pa.array([len(x) for x in ids], pa.int32())


def _encoded(docs: DataFrame, key: str, text: str, vocabulary: str | None, made: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = narrow.schema["k"].dataType.simpleString()
    out = spread(narrow).mapInArrow(_mapper(shared, "t", ["k"], make), f"k {kind}, {made}")
    return out.withColumnRenamed("k", key)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, ids array<int>: the token ids of every row's text, without special tokens.

    Null and empty texts give an empty array; strings that look like special tokens are ordinary text; nothing is
    trimmed or normalised. Rows come out as often as they come in (also for null or repeated keys); further columns
    are ignored, so they cannot clash; an empty table gives no rows.
    """
    return _encoded(docs, key, text, vocabulary, "ids array<int>", _id_lists)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, n_tokens int: as `encode_corpus`, but only the number of ids leaves the worker."""
    return _encoded(docs, key, text, vocabulary, "n_tokens int", _counts)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
