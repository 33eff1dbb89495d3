"""References to records that do not exist: missing, deleted or late parents, per reference and per table and month.

Plan: the distinct non-null foreign keys (combined map-side, so a hot key is one row per task) are checked against
the parent keys. Only keys that can give a case are joined back to the references, with hot keys salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions.runtime import lookup_join, stage, table

REF_COLUMNS = ["ref_table", "ref_field", "row_key", "space", "scope", "ref_key", "ref_time"]
_KEY = ["space", "scope", "ref_key"]


def latest(df: DataFrame, key: list[str], order: str = "ingested_at") -> DataFrame:
    """One row per key, the one delivered last (null delivery times first); a row with a null key part is a record of its
    own."""
    rest = [c for c in df.columns if c not in key]
    unkeyed = F.when(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False)), F.monotonically_increasing_id())
    picked = df.groupBy(*key, unkeyed.alias("__own")).agg(
        F.max_by(F.struct(*rest), F.coalesce(F.col(order).cast("string"), F.lit(""))).alias("__r")
    )
    return picked.select(*key, *[F.col("__r")[c].alias(c) for c in rest])


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Every reference whose parent is missing, deleted or late.

    refs: ref_table, ref_field, row_key, space, scope, ref_key, ref_time (further columns are ignored); `space` names
    the parent table and `scope` the part of it the key lives in ('' where keys are global). parents: space, scope,
    ref_key, deleted_at, ingested_at, any number of rows per key.

    Result: ref_table, ref_field, row_key, ref_key, ref_state, ref_month. A null ref_key or scope is no reference;
    keys compare exactly, '' is a key. State: missing if no parent row has the key, else deleted if any has
    deleted_at, else late if the key's earliest ingested_at is after ref_time (never for a null ref_time, whose month
    is null too). Repeated rows of one reference come out once. Empty parents make every reference missing; empty
    refs give no rows.
    """
    refs = refs.select(*REF_COLUMNS).where(F.col("ref_key").isNotNull() & F.col("scope").isNotNull())
    keys = refs.groupBy(*_KEY).agg(F.min("ref_time").alias("first_ref"))
    held = parents.groupBy(*_KEY).agg(
        F.max(F.col("deleted_at").isNotNull()).alias("deleted"), F.min("ingested_at").alias("arrived")
    )
    missing = keys.join(held, _KEY, "left_anti").select(
        *_KEY, F.lit("missing").alias("key_state"), F.lit(None).cast(held.schema["arrived"].dataType).alias("arrived")
    )
    doubtful = (
        keys.join(held, _KEY)
        .where(F.col("deleted") | (F.col("arrived") > F.col("first_ref")))
        .select(*_KEY, F.when(F.col("deleted"), "deleted").otherwise("late").alias("key_state"), "arrived")
    )
    suspects = stage(missing.unionByName(doubtful), "suspect-keys")
    found = lookup_join(refs, suspects, _KEY).where(
        (F.col("key_state") != "late") | (F.col("arrived") > F.col("ref_time"))
    )
    return found.select(
        "ref_table", "ref_field", "row_key", "ref_key", F.col("key_state").alias("ref_state"),
        F.substring(F.col("ref_time").cast("string"), 1, 7).alias("ref_month"),
    ).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references counted per table, field, state and month."""
    return found.groupBy("ref_table", "ref_field", "ref_state", "ref_month").agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_distinct("ref_key").alias("n_keys")
    )


def note_references(relations: DataFrame, qa: DataFrame) -> DataFrame:
    """The references of relations (both ends) and of predicted support passages, in the shape of REF_COLUMNS."""
    rel = latest(relations.select("relation_id", "source_id", "target_id", "extracted_at", "ingested_at"), ["relation_id"])
    ends = rel.select(
        F.lit("note_relations").alias("ref_table"),
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("ref_key")) for c in ("source_id", "target_id")]
            )
        ).alias("e"),
        F.col("relation_id").alias("row_key"), F.lit("note").alias("space"), F.lit("").alias("scope"),
        F.col("extracted_at").alias("ref_time"),
    ).select("ref_table", "e.ref_field", "row_key", "space", "scope", "e.ref_key", "ref_time")
    item = latest(qa.select("id", "predicted_support_idxs", "predicted_at", "ingested_at"), ["id"])
    support = item.select(
        F.lit("qa_results").alias("ref_table"), F.lit("predicted_support_idxs").alias("ref_field"),
        F.col("id").alias("row_key"), F.lit("passage").alias("space"), F.col("id").alias("scope"),
        F.explode(F.array_distinct(F.col("predicted_support_idxs").cast("array<string>"))).alias("ref_key"),
        F.col("predicted_at").alias("ref_time"),
    )
    return ends.unionByName(support)


def note_parents(notes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Notes and passages as parents of `note_references`."""
    return notes.select(
        F.lit("note").alias("space"), F.lit("").alias("scope"), F.col("note_id").alias("ref_key"), "deleted_at", "ingested_at"
    ).unionByName(
        paragraphs.select(
            F.lit("passage").alias("space"), F.col("item_id").alias("scope"), F.col("idx").cast("string").alias("ref_key"),
            "deleted_at", "ingested_at",
        )
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan reference of note_relations and qa_results."""
    t = {n: table(spark, sf_dir, n) for n in ("note_relations", "qa_results", "atomic_notes", "paragraphs")}
    refs = stage(note_references(t["note_relations"], t["qa_results"]), "references")
    return orphan_references(refs, note_parents(t["atomic_notes"], t["paragraphs"]))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, state and month."""
    return orphan_report(p4_found(spark, sf_dir))


_P4 = """
WITH rel AS (
  SELECT relation_id, source_id, target_id, extracted_at FROM note_relations
  QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY ingested_at DESC NULLS LAST) = 1),
qa AS (
  SELECT id, predicted_support_idxs, predicted_at FROM qa_results
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1),
refs AS (
  SELECT 'note_relations' AS ref_table, 'source_id' AS ref_field, relation_id AS row_key, '' AS scope, source_id AS ref_key, extracted_at AS ref_time FROM rel
  UNION ALL SELECT 'note_relations', 'target_id', relation_id, '', target_id, extracted_at FROM rel
  UNION ALL SELECT 'qa_results', 'predicted_support_idxs', id, id, i::VARCHAR, predicted_at
  FROM (SELECT id, predicted_at, unnest(list_distinct(predicted_support_idxs)) AS i FROM qa)),
parents AS (
  SELECT 'note_relations' AS ref_table, '' AS scope, note_id AS ref_key, bool_or(deleted_at IS NOT NULL) AS deleted, min(ingested_at) AS arrived FROM atomic_notes GROUP BY note_id
  UNION ALL SELECT 'qa_results', item_id, idx::VARCHAR, bool_or(deleted_at IS NOT NULL), min(ingested_at) FROM paragraphs GROUP BY item_id, idx),
states AS (
  SELECT DISTINCT r.ref_table, r.ref_field, r.row_key, r.ref_key,
    CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN p.deleted THEN 'deleted' WHEN p.arrived > r.ref_time THEN 'late' END AS ref_state,
    strftime(r.ref_time, '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN parents p ON r.ref_table = p.ref_table AND r.scope = p.scope AND r.ref_key = p.ref_key
  WHERE r.ref_key IS NOT NULL),
found AS (SELECT * FROM states WHERE ref_state IS NOT NULL)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_report": _P4
    + """SELECT ref_table, ref_field, ref_state, ref_month, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys
FROM found GROUP BY ref_table, ref_field, ref_state, ref_month""",
}
