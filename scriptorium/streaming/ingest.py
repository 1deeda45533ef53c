"""Incremental ingest: new files become documents and chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.config import DEFAULTS, Settings
from scriptorium.operators.chunking import chunk_documents
from scriptorium.sources.files import parse_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_documents(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Documents of the files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_trigger)).load(folder)
    return parse_files(files.select("path", "content"))


def run_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Write documents and chunks of each micro-batch under ``batch=<n>``; a batch that is run again
    overwrites its own folder, so the result holds each file once. Ends when all files are read."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        chunk_documents(batch.where("error_class is null"), settings).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        batch.unpersist()

    return stream_documents(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling windows, with a watermark for late rows (stream or table)."""
    by = events.withWatermark("ts", late) if events.isStreaming else events
    return by.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "n", "value")
