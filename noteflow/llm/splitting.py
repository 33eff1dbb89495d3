"""Problem 1: cutting oversized texts at natural boundaries, with an overlap between consecutive pieces.

The least number of pieces sets equal-length targets for the cuts. Each cut snaps to the strongest boundary near its
target that keeps the piece within the limit and the rest within its pieces; if some cut finds none, or only a weaker
one than stands near its target, pieces are added and the targets are placed anew. More than twice the least number
are not made for stronger boundaries; if the targets then still meet no boundary, each cut goes to the farthest boundary
that its piece reaches, which finds natural cuts wherever the text allows any. Only where it allows none, cuts are made
at the limit.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions.runtime import spread, table
from noteflow.operators.references import latest

LIMIT, OVERLAP = 512, 50
#: By how much the number of pieces grows from one attempt to the next, at least by one piece.
GROWTH = 0.1

#: Boundaries by strength; a cut is made behind the match.
_BOUNDARIES = [
    (5, regex.compile(r"(?:\r?\n[ \t]*){2,}|\u2029")),  # paragraph
    (4, regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*")),  # sentence
    (3, regex.compile(r"\r?\n|[\u2028\u0085]")),  # line
    (2, regex.compile(r"[;:,]\s+|[，；：、]|\s[–—-]\s")),  # clause
    (1, regex.compile(r"\s+|\p{P}+")),  # word
    (0, regex.compile(r"\s|\p{P}")),  # within a run of spaces or marks
]


class Piece(NamedTuple):
    start: int
    end: int
    kind: str  # boundary, forced (no boundary within reach) or end (of the text)


def boundaries(text: str) -> tuple[list[int], dict[int, int]]:
    """Places behind a boundary, in order, and their strengths."""
    strength: dict[int, int] = {}
    for s, pattern in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            strength[m.end()] = s
    return sorted(strength), strength


def _place(length: int, n: int, limit: int, overlap: int, at: list[int], strength: dict[int, int], force: bool) -> tuple[list[Piece], int] | None:
    """n pieces and how many cuts are weaker than a boundary near their target, or None if a cut finds no boundary (with
    `force` such a cut is made at the limit and takes further pieces)."""
    step = limit - overlap
    pieces, start, weak = [], 0, 0
    total = n
    while True:
        left = total - len(pieces)
        if length - start <= limit and (left <= 1 or force):
            return [*pieces, Piece(start, length, "end")], weak
        if left <= 1:
            if not force:
                return None
            total += 1
            left = 2
        target = start + overlap + (length - start - overlap) / left
        low = max(start + overlap + 1, 0 if force else length - (left - 1) * step - overlap)
        high = min(start + limit, length - 1)
        reach = at[bisect_left(at, low) : bisect_right(at, high)]
        if reach:
            near = [b for b in reach if abs(b - target) <= limit / 5] or reach
            end = max(near, key=lambda b: (strength[b] - 4 * abs(b - target) / limit, b))
            around = at[bisect_left(at, target - limit / 5) : bisect_right(at, target + limit / 5)]
            weak += strength[end] < max((strength[b] for b in around), default=0)
            pieces.append(Piece(start, end, "boundary"))
        elif force:
            end = start + limit
            pieces.append(Piece(start, end, "forced"))
        else:
            return None
        start = end - overlap


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """Pieces of at most `limit` characters that cover the text in order, each beginning with the last `overlap`
    characters of the one before. A text within the limit is one piece, an empty one too."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    length = len(text)
    if length <= limit:
        return [Piece(0, length, "end")]
    at, strength = boundaries(text)
    least = -(-(length - overlap) // (limit - overlap))
    best = None
    n = least
    while n <= 2 * least:
        placed = _place(length, n, limit, overlap, at, strength, force=False)
        if placed and (best is None or placed[1] < best[1]):
            best = placed
        if best and not best[1]:
            break
        n += max(1, int(n * GROWTH))
    if best:
        return best[0]
    return _farthest(length, limit, overlap, at) or _place(length, least, limit, overlap, at, strength, force=True)[0]


def _farthest(length: int, limit: int, overlap: int, at: list[int]) -> list[Piece] | None:
    """Each cut at the farthest boundary within the limit, or None if some piece reaches none: then no choice of cuts is
    natural throughout, as a farther cut never reaches less."""
    pieces, start = [], 0
    while length - start > limit:
        k = bisect_right(at, min(start + limit, length - 1)) - 1
        if k < 0 or at[k] <= start + overlap:
            return None
        pieces.append(Piece(start, at[k], "boundary"))
        start = at[k] - overlap
    return [*pieces, Piece(start, length, "end")]


def has_solid_run(text: str, limit: int = LIMIT) -> bool:
    """True if more than `limit` successive characters are neither white space nor punctuation."""
    return regex.search(rf"[^\s\p{{P}}]{{{limit + 1}}}", text) is not None


def split_items(items: DataFrame, key: str, text: str, keep: list[str] = (), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every item longer than `limit`: key, kept columns, piece_no (from 0), piece_start, piece_end
    (code points), piece, end_kind, cut.

    end_kind: boundary, forced (no boundary within reach of this cut) or end. cut, the same for all pieces of an item:
    forced if the text has a run of more than `limit` characters without white space and punctuation, so that no choice
    of cuts could be natural throughout, else boundary. Items within the limit, null and empty texts give no rows.
    Repeated rows are split each; a null key is kept; an empty table gives no rows. Only long texts reach Python.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    rows = items.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)], F.col(text).alias("__t"))
    rows = rows.where(F.char_length("__t") > limit)
    names = [c for c in rows.columns if c != "__t"]

    def run(batches):
        for b in batches:
            for i, t in enumerate(b.column("__t").to_pylist()):
                pieces = split_text(t, limit, overlap)
                cut = "forced" if has_solid_run(t, limit) else "boundary"
                n = len(pieces)
                carried = [b.column(c).take(pa.array([i] * n, pa.int32())) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*carried, pa.array(range(n), pa.int32()), pa.array([p.start for p in pieces], pa.int32()), pa.array([p.end for p in pieces], pa.int32()),
                     pa.array([t[p.start : p.end] for p in pieces], pa.string()), pa.array([p.kind for p in pieces], pa.string()), pa.array([cut] * n, pa.string())],
                    [*names, "piece_no", "piece_start", "piece_end", "piece", "end_kind", "cut"],
                )

    schema = ", ".join(
        [f"__k {kinds[key]}", *[f"__c{i} {kinds[c]}" for i, c in enumerate(keep)], "piece_no int, piece_start int, piece_end int, piece string, end_kind string, cut string"]
    )
    out = spread(rows).mapInArrow(run, schema).withColumnRenamed("__k", key)
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"__c{i}", c)
    return out


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # short texts are not shuffled: they give no rows, whichever delivery is the last
    long = F.when(F.char_length("original_text") > LIMIT, F.col("original_text")).alias("original_text")
    return latest(table(spark, sf_dir, "atomic_notes").select("note_id", "chunk_index", long, "ingested_at"), ["note_id"])


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every note whose chunk is longer than LIMIT."""
    return split_items(_notes(spark, sf_dir), "note_id", "original_text", ["chunk_index"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that had to be split, and whether their cuts could all be natural."""
    return p1_pieces(spark, sf_dir).where("piece_no = 0").select("note_id", "chunk_index", "cut")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL: dict[str, str] = {}
