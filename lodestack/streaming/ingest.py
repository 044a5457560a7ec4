"""Arriving documents: an incremental file source, dedup against history by hash prefix, bounded micro-batches; and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.functions.text import normalised_hash
from lodestack.storage import keep

#: Hexadecimal digits of a hash that name a directory: 256 of them.
PREFIX = 2


def arrivals(spark: SparkSession, path: str, schema: str, files_per_batch: int = 3) -> DataFrame:
    """A stream of Parquet files as they appear, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def known_hashes(spark: SparkSession, library: str, prefixes: list[str], before: int) -> DataFrame | None:
    """(content_hash) of what the library has under these prefixes of hashes, from other batches than this one; None where there is no library yet.

    prefix and batch are directories, so no other prefix's files are opened.
    """
    try:
        rows = spark.read.schema("content_hash string, batch int, prefix string").parquet(library)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("prefix").isin(prefixes) & (F.col("batch") != before)).select("content_hash")


def ingest(stream: DataFrame, library: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append stream(doc_id, text, ...) to the Parquet library, each text once: of a batch the smallest doc_id, and none that the library has.

    The library's files lie by batch and by the first PREFIX digits of the text's hash; a batch is compared with the files of its own prefixes alone. A batch writes
    below its own number, so a batch that runs again replaces what it wrote. Ends when what has arrived is processed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("content_hash", normalised_hash(F.coalesce("text", F.lit(""))))
        rows = keep(hashed.withColumn("prefix", F.substring("content_hash", 1, PREFIX)), "arrivals")
        first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
        rows = rows.join(first, ["content_hash", "doc_id"], "left_semi").dropDuplicates(["content_hash"])
        prefixes = [r["prefix"] for r in rows.select("prefix").distinct().collect()]
        known = known_hashes(spark, library, prefixes, number)
        if known is not None:
            rows = rows.join(known, "content_hash", "left_anti")
        (process(rows) if process else rows).write.mode("overwrite").partitionBy("prefix").parquet(f"{library}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by event-time window; an extension, for batch and stream alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
