"""Column functions on text: tokens, sentences, similarity, cleaning. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters; the same in Java, RE2 and Python, unlike \\w.
TOKEN = r"[\p{L}\p{N}_]+"
# Words that carry no meaning of their own.
STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the to was were will with who what when where which how did does do".split()


def blank(c: Column) -> Column:
    """True for null and for text without a visible character."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", F.lit(True))


def tokens(c: Column) -> Column:
    """Lower-case words; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def word_set(c: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct words split at white space, lower case, without `stop_words`."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words])) if stop_words else words


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union of two arrays of distinct values; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def sentences(c: Column) -> Column:
    """Sentences, cut behind an end mark and the spaces after it, trimmed, empty ones dropped."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), r"([。！？.!?])\s*", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def clean(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case, ASCII punctuation dropped, white space collapsed."""
    return clean(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""))


def alnum_ratio(c: Column) -> Column:
    """Share of letters and digits among the characters."""
    return F.when(F.char_length(c) > 0, F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / F.char_length(c)).otherwise(F.lit(0.0))


def chunk_by_length(c: Column, size: int, overlap: int = 0) -> Column:
    """Array of chunks: sentences packed greedily to `size` characters (one space between), each chunk after the first
    beginning with the last `overlap` characters of the one before. A longer sentence is a chunk of its own."""

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        fits = (acc["cur"] == "") | (F.char_length(joined) <= size)
        tail = F.right(acc["cur"], F.lit(overlap)) if overlap else F.lit("")
        begun = F.when(tail == "", s).otherwise(F.concat(tail, F.lit(" "), s))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(fits, joined).otherwise(begun).alias("cur"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(
        sentences(c), start, add, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
    )


def rounded(c: Column, digits: int) -> Column:
    """c rounded as DuckDB does it: times 10 ** digits, to the nearest whole number (halves away from zero), divided again.
    `F.round` rounds the shortest decimal form instead, which differs where the product is or misses a half."""
    return F.round(c * float(10**digits), 0) / float(10**digits)
