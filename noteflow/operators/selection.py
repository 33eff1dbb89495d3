"""Selection in order: what a greedy choice depends on earlier choices, per query, and set-similarity joins.

The candidates of one query are few (they come out of a top-k), so each query is one group of a grouped map; many
queries run in parallel. Similarity joins compare only rows that share a rare word of their prefix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions import text as tx
from noteflow.functions.runtime import drop_stage, lookup_join, spread, stage
from noteflow.operators import graph
from noteflow.operators.evaluation import items, passages, question_passage_scores
from noteflow.operators.notes import SQL_NOTES, notes

#: Words that are more than 1 / FREQUENT of all count as frequent, so there are fewer of them; the number of parts up to which sets
#: meet by a rare word and a part.
FREQUENT, BOTH = 50_000, 8


def _sets(texts) -> list[set]:
    return [set((t or "").lower().split()) for t in texts]


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def _grouped(df: DataFrame, pick: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """query, candidate, place: the candidates that `pick` names, in its order; candidates come sorted by score, then key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "candidate"], ascending=[False, True], ignore_index=True)
        chosen = pick(pdf)
        return pd.DataFrame({"query": pdf["query"].iloc[chosen].values, "candidate": pdf["candidate"].iloc[chosen].values, "place": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    kinds = dict(df.dtypes)
    return df.groupBy("query").applyInPandas(run, f"query {kinds['query']}, candidate {kinds['candidate']}, place int")


def mmr(df: DataFrame, k: int = 5, relevance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: each step takes the largest relevance * score - (1 - relevance) * overlap with what is
    chosen. df: query, candidate, score, text."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        sets, chosen, left = _sets(pdf.text), [], list(range(len(pdf)))
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (round(relevance * pdf.score[i] - (1 - relevance) * max((_overlap(sets[i], sets[j]) for j in chosen), default=0.0), 9), -i))
            chosen.append(best)
            left.remove(best)
        return chosen

    return _grouped(df, pick)


def diverse(df: DataFrame, k: int = 5) -> DataFrame:
    """Each step takes the largest 0.7 * (1 - mean overlap with what is chosen) + 0.3 * score, at most 1 of it."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        sets, chosen, left = _sets(pdf.text), [], list(range(len(pdf)))
        while left and len(chosen) < k:
            gain = lambda i: 0.7 * (1 - (sum(_overlap(sets[i], sets[j]) for j in chosen) / len(chosen) if chosen else 0.0)) + 0.3 * min(1.0, pdf.score[i])
            best = max(left, key=lambda i: (round(gain(i), 9), -i))
            chosen.append(best)
            left.remove(best)
        return chosen

    return _grouped(df, pick)


def within_budget(df: DataFrame, tokens: int = 1800, least: float = 0.1) -> DataFrame:
    """Candidates in order of score as long as they fit the budget (a quarter of their characters, 50 at least) and gain
    more than `least`: score minus half the largest overlap with what is chosen."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        sets, chosen, used = _sets(pdf.text), [], 0
        for i in range(len(pdf)):
            cost = max(50, int(len(pdf.text[i] or "") * 0.25))
            gain = pdf.score[i] - 0.5 * max((_overlap(sets[i], sets[j]) for j in chosen), default=0.0)
            if used + cost <= tokens and gain > least:
                chosen.append(i)
                used += cost
        return chosen

    return _grouped(df, pick)


def suppress_near(df: DataFrame, least: float = 0.85, keep: int = 1) -> DataFrame:
    """Of candidates whose words overlap at least `least` with an earlier leader only the best `keep` stay."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        sets, leaders, chosen = _sets(pdf.text), [], []
        for i in range(len(pdf)):
            for at, members in leaders:
                if _overlap(sets[i], sets[at]) >= least:
                    members.append(i)
                    if len(members) <= keep:
                        chosen.append(i)
                    break
            else:
                leaders.append((i, [i]))
                chosen.append(i)
        return chosen

    return _grouped(df, pick)


def cover_paths(df: DataFrame, least: int = 3) -> DataFrame:
    """Candidates that add a new member of `paths` (array), and the first `least` whatever they add."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        seen, chosen = set(), []
        for i in range(len(pdf)):
            own = set(pdf.paths[i]) if pdf.paths[i] is not None else set()
            if own - seen or len(chosen) < least:
                chosen.append(i)
                seen |= own
        return chosen

    return _grouped(df, pick)


def word_sets(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Staged tables: members (key, sid) and sets (sid, s): sid stands for a set of words, so equal sets meet once."""
    rows = df.select(F.col(key), F.array_sort(tx.word_set(F.col(text))).alias("s")).where(F.size("s") > 0)
    rows = stage(rows.withColumn("sid", F.md5(F.array_join("s", " "))), "word-sets")
    sets = stage(rows.groupBy("sid").agg(F.first("s").alias("s")), "distinct-sets")
    return rows.select(key, "sid"), sets


def _parts(k: np.ndarray) -> np.ndarray:
    """k or more: each number up to BOTH, then every 1.2-fold, so a set has keys for few numbers of parts."""
    return np.where(k <= BOTH, k, np.ceil(BOTH * 1.2 ** np.ceil(np.log(np.maximum(k, 1) / BOTH) / math.log(1.2) - 1e-9))).astype(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _set_keys(sizes: np.ndarray, h: np.ndarray, df: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set and key of all keys of the sets, and the parity of each set's words in 64 bits. h: hashes of the words of all sets, one
    set after the other, df: how frequent they are."""
    n, of = sizes.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    parity = np.zeros(len(n), np.uint64)
    np.bitwise_xor.at(parity, of, np.uint64(1) << (_mixed(h) & np.uint64(63)))
    # the rarest words, in an order that all sets share
    order = np.lexsort((h, df, of))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    rare = order[place < np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, n)]
    differ = lambda m: np.floor((1 - least) / (1 + least) * (n + m) + 1e-6).astype(np.int64)
    low, high = _parts(differ(np.ceil(least * n - 1e-6)) + 1), _parts(differ(np.floor(n / least + 1e-6)) + 1)
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    top = int(high.max(initial=1))
    for k in sorted({int(x) for x in _parts(np.arange(2, top + 1))}):
        has = (low <= k) & (k <= high)
        if not has.any():
            continue
        row = np.cumsum(has) - 1
        mine = has[of]
        sums = np.zeros((int(has.sum()), k), np.uint64)
        np.add.at(sums, (row[of[mine]], (_mixed(h[mine] + np.uint64(k)) % np.uint64(k)).astype(np.int64)), _mixed(h[mine]))
        part = _mixed(sums + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        if k <= BOTH:
            r = rare[has[of[rare]]]
            owners.append(np.repeat(of[r], k))
            keys.append(_mixed(part[row[of[r]]] ^ h[r][:, None]).ravel())
        else:
            owners.append(np.repeat(np.flatnonzero(has), k))
            keys.append(part.ravel())
    return np.concatenate(owners), np.concatenate(keys), parity


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of different sets with a Jaccard similarity of `least` or more, exactly. The words of a set fall into parts
    by their hash, one more than two such sets can differ in words, so they have a part in common; they also share a word
    among the rarest size - ceil(least * size) + 1 of each. Sets meet by both, those of more than BOTH parts by parts; what
    differs in too many bits of the words' parity is dropped where it meets, so few pairs are written."""
    words = sets.select(F.explode("s").alias("w"))
    often = words.count() // FREQUENT
    sent = sets.sparkSession.sparkContext.broadcast(dict(words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > often).collect()))

    def run(batches):
        for b in batches:
            s = b.column("s")
            flat = s.flatten().dictionary_encode()
            own = flat.dictionary.to_pylist()
            at = flat.indices.to_numpy()
            h = np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64)[at]
            sizes = np.diff(s.offsets.to_numpy())
            owner, key, parity = _set_keys(sizes, h, np.array([sent.value.get(w, 0) for w in own], np.int64)[at], least)
            cols = [pa.array(key.view(np.int64)), b.column("id").take(pa.array(owner)), pa.array(sizes[owner].astype(np.int32)), pa.array(parity[owner].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "n", "bits"])

    ids = sets.select(F.xxhash64("sid").alias("id"), "sid", "s")
    keyed = stage(spread(ids.select("id", "s")).mapInArrow(run, "key bigint, id bigint, n int, bits bigint"), "set-keys")
    a, b = keyed.toDF("key", "ia", "na", "pa"), keyed.toDF("key", "ib", "nb", "pb")
    near = (F.col("na") * least <= F.col("nb") + 1e-9) & (F.col("nb") * least <= F.col("na") + 1e-9)
    few = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= (1 - least) / (1 + least) * (F.col("na") + F.col("nb")) + 1e-6
    pairs = stage(a.join(b, "key").where((F.col("ia") < F.col("ib")) & near & few).select("ia", "ib").distinct(), "set-pairs")
    drop_stage(keyed)
    full = pairs.join(ids.toDF("ia", "x", "sa"), "ia").join(ids.toDF("ib", "y", "sb"), "ib")
    full = full.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round(tx.jaccard(F.col("sa"), F.col("sb")), 9).alias("similarity"))
    return full.where(F.col("similarity") >= least)


def lexical_duplicates(df: DataFrame, key: str, text: str, least: float = 0.85) -> DataFrame:
    """key, class_id, links: rows whose words overlap at least `least` with another row's, with the smallest key of their
    connected component and the number of different word sets they are linked with. Rows with equal word sets are one
    vertex; rows without words stay out."""
    members, sets = word_sets(df, key, text)
    pairs = stage(similar_sets(sets, least), "similar-sets")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("sid", "o")
    links = both.groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    classes = graph.components(both.select(F.col("sid").alias("src"), F.col("o").alias("dst"), F.lit(1.0).alias("weight"))).toDF("sid", "component")
    per = stage(members.groupBy("sid").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first")), "set-members")
    info = per.join(links, "sid", "left").join(classes, "sid", "left").withColumn("component", F.coalesce("component", "sid")).withColumn("links", F.coalesce("links", F.lit(0)))
    info = stage(info, "set-classes")
    first = info.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("rows").alias("size"))
    known = info.join(first, "component").where("size > 1").select("sid", "class_id", "links")
    return lookup_join(members, known, ["sid"]).select(key, "class_id", "links")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """query (question), candidate (idx), score, text: the passages of each question."""
    q, p = items(s, d), passages(s, d)
    scores = question_passage_scores(q, p).withColumn("score", F.round(0.5 * F.col("jaccard") + 0.5 * F.col("keyword"), 6))
    t = p.select(F.col("item_id").alias("id"), "idx", F.coalesce("paragraph_text", F.lit("")).alias("text"))
    return scores.join(t, ["id", "idx"]).select(F.col("id").alias("query"), F.col("idx").alias("candidate"), "score", "text")


QUERIES = {
    "passages_mmr": lambda s, d: mmr(_candidates(s, d)),
    "passages_diverse": lambda s, d: diverse(_candidates(s, d)),
    "passages_in_budget": lambda s, d: within_budget(_candidates(s, d), least=-1.0),
    "passages_unlike": lambda s, d: suppress_near(_candidates(s, d)),
    "note_lexical_duplicates": lambda s, d: lexical_duplicates(notes(s, d), "note_id", "content"),
}

_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+')), lambda w: w <> '')"
SQL = {
    "note_lexical_duplicates": f"""WITH RECURSIVE {SQL_NOTES}, w AS (SELECT note_id, list_sort({_WORDS.format('content')}) AS s FROM notes), x AS (SELECT note_id, s FROM w WHERE len(s) > 0),
d AS (SELECT DISTINCT s FROM x), p AS (SELECT a.s AS a, b.s AS b FROM d a JOIN d b ON a.s <> b.s AND len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE >= 0.85),
l AS (SELECT a AS s, count(*) AS links FROM p GROUP BY a), e AS (SELECT x.note_id AS u, y.note_id AS v FROM x JOIN x y ON x.s = y.s UNION SELECT x.note_id, y.note_id FROM x JOIN p ON x.s = p.a JOIN x y ON y.s = p.b),
c AS (SELECT note_id AS u, note_id AS m FROM x UNION SELECT e.v, c.m FROM c JOIN e ON c.u = e.u), k AS (SELECT u AS note_id, min(m) AS class_id FROM c GROUP BY u), n AS (SELECT *, count(*) OVER (PARTITION BY class_id) AS size FROM k)
SELECT n.note_id, class_id, coalesce(links, 0) AS links FROM n JOIN x USING (note_id) LEFT JOIN l ON l.s = x.s WHERE size > 1""",
}
