"""Incremental ingestion with Structured Streaming: notes arrive as files, sentences and counts are kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from noteflow.functions import text as tx

EVENT_SCHEMA = T.StructType([T.StructField("note_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("source", T.StringType()), T.StructField("ingested_at", T.TimestampType())])


def note_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Notes as they arrive as JSON lines files in a directory."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def without_repeats(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each note once as long as it comes again within the watermark."""
    return stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["note_id"])


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, source, notes, sentences per window of arrival; windows close when the watermark has passed them."""
    counted = stream.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window).alias("w"), "source")
    return counted.agg(F.count(F.lit(1)).alias("notes"), F.sum(F.size(tx.sentences(F.col("content")))).alias("sentences")).select(F.col("w.start").alias("window_start"), "source", "notes", "sentences")


def upsert_batches(path: str, key: str = "note_id", order: str = "ingested_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each micro-batch is one directory of the newest row per key; a batch that is run again
    overwrites its own directory, so every row counts once."""

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current_state(spark: SparkSession, path: str, key: str = "note_id", order: str = "ingested_at") -> DataFrame:
    """The newest row of each key over all batches."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("batch"))
    return spark.read.parquet(path).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "batch")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes all files that have arrived since the last run and stops; the checkpoint remembers them."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
