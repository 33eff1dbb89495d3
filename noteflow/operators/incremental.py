"""Operators of incremental runs: what changed between two states, what depends on it, when an index is rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions.runtime import table


def diff_states(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """key, status (new, modified, unchanged or deleted) of every key in either state; a state has each key once. Null
    digests are equal to each other only."""
    b, a = before.select(key, F.col(digest).alias("old"), F.lit(1).alias("b")), after.select(key, F.col(digest).alias("new"), F.lit(1).alias("a"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return b.join(a, key, "full").select(key, status.alias("status"))


def processing_plan(changes: DataFrame, depends: DataFrame, key: str = "path") -> DataFrame:
    """key, action: process what is new or modified and what depends on it directly, clean up what is deleted, skip the
    rest. depends: key, on."""
    touched = changes.where("status != 'unchanged'").select(F.col(key).alias("on"))
    dependents = depends.join(touched, "on", "left_semi").select(key).distinct().withColumn("d", F.lit(1))
    action = F.when(F.col("status") == "deleted", "clean").when((F.col("status") != "unchanged") | F.col("d").isNotNull(), "process").otherwise("skip")
    return changes.join(dependents, key, "left").select(key, action.alias("action"))


def rebuild_reasons(index: DataFrame, most_rows: int = 10_000, most_hours: int = 168) -> DataFrame:
    """name, rows, hours, rebuild: an index is rebuilt when it has grown over `most_rows` or grown older than `most_hours`.
    index: name, rows, hours since it was built (null: never)."""
    return index.withColumn("rebuild", (F.col("rows") >= most_rows) | F.coalesce(F.col("hours") >= most_hours, F.lit(True)))


def file_states(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """path, hash: the files of the notes that were delivered until a day, with the hash delivered last."""
    n = table(spark, sf_dir, "atomic_notes").where(F.col("source_info").isNotNull() & (F.col("ingested_at") < F.lit(until).cast("timestamp_ntz")))
    return n.groupBy(F.col("source_info.file_path").alias("path")).agg(F.max(F.struct("ingested_at", F.col("source_info.file_hash").alias("h"))).alias("m")).select("path", F.col("m.h").alias("hash"))


def _changes(s: SparkSession, d: str) -> DataFrame:
    return diff_states(file_states(s, d, "2024-07-01"), file_states(s, d, "2026-01-01"))


def _plan(s: SparkSession, d: str) -> DataFrame:
    """Files depend on the files that their notes refer to."""
    n = table(s, d, "atomic_notes").where("source_info IS NOT NULL").select("note_id", F.col("source_info.file_path").alias("path")).distinct()
    r = table(s, d, "note_relations").where("lower(relation_type) = 'reference'").select("source_id", "target_id").distinct()
    depends = r.join(n.withColumnRenamed("note_id", "source_id"), "source_id").join(n.select(F.col("note_id").alias("target_id"), F.col("path").alias("on")), "target_id").where("path != on").select("path", "on").distinct()
    return processing_plan(_changes(s, d), depends)


QUERIES = {
    "file_changes": _changes,
    "processing_plan": _plan,
    "index_rebuild": lambda s, d: rebuild_reasons(table(s, d, "note_embeddings").groupBy(F.coalesce("model_name", F.lit("none")).alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.floor((F.lit(1751328000) - F.unix_seconds(F.max("embedded_at").cast("timestamp"))) / 3600).alias("hours"))),
}

_STATES = """st AS (SELECT source_info.file_path AS path, ingested_at, source_info.file_hash AS h FROM atomic_notes WHERE source_info IS NOT NULL),
b AS (SELECT path, arg_max(h, (ingested_at, h)) AS old FROM st WHERE ingested_at < TIMESTAMP '2024-07-01' GROUP BY path), a AS (SELECT path, arg_max(h, (ingested_at, h)) AS new FROM st WHERE ingested_at < TIMESTAMP '2026-01-01' GROUP BY path),
ch AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN old IS NOT DISTINCT FROM new THEN 'unchanged' ELSE 'modified' END AS status FROM b FULL JOIN a ON a.path = b.path)"""
SQL = {
    "file_changes": f"WITH {_STATES} SELECT * FROM ch",
    "processing_plan": f"""WITH {_STATES}, n AS (SELECT DISTINCT note_id, source_info.file_path AS path FROM atomic_notes WHERE source_info IS NOT NULL),
dep AS (SELECT DISTINCT x.path, y.path AS needs FROM note_relations r JOIN n x ON r.source_id = x.note_id JOIN n y ON r.target_id = y.note_id WHERE lower(relation_type) = 'reference' AND x.path <> y.path),
d AS (SELECT DISTINCT dep.path FROM dep JOIN ch ON dep.needs = ch.path WHERE ch.status <> 'unchanged')
SELECT path, CASE WHEN status = 'deleted' THEN 'clean' WHEN status <> 'unchanged' OR path IN (SELECT path FROM d) THEN 'process' ELSE 'skip' END AS action FROM ch""",
    "index_rebuild": """WITH i AS (SELECT coalesce(model_name, 'none') AS name, count(*) AS rows, floor((1751328000 - epoch(max(embedded_at))::BIGINT) / 3600.0::DOUBLE)::BIGINT AS hours FROM note_embeddings GROUP BY 1)
SELECT *, rows >= 10000 OR coalesce(hours >= 168, true) AS rebuild FROM i""",
}
