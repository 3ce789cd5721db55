"""New files as a stream: chunks and postings are appended as files appear.  Deletions aren't seen; SearchSession.update() finds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, retrieval
from ..sources.store import Store


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, width: int = 1024, pattern: str = "*.{md,txt}") -> None:
    """Take in the files that came since the last call, then stop; the checkpoint makes each file count once."""

    def upsert(batch: DataFrame, _: int) -> None:
        docs = batch.select(F.regexp_replace("path", "^file:/*", "/").alias("filename"), F.decode("content", "UTF-8").alias("text"))
        chunks = chunking.fixed(docs, width).select(F.md5(F.concat_ws("|", "filename", "ordinal")).alias("chunk_id"), "filename", "ordinal", F.col("chunk").alias("text"))
        # what a batch that broke off has appended already isn't appended again; the two tables are looked at each by itself
        new = lambda name, rows: rows.join(store.read(name).select("chunk_id").distinct(), "chunk_id", "left_anti") if store.exists(name) else rows
        store.append("chunks", new("chunks", chunks))
        store.append("postings", new("postings", retrieval.postings(chunks)))

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type; rows later than late are dropped in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
