"""Incremental tables with Structured Streaming: new documents only, job states, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.chunks import paragraphs
from quarry.operators.lexical import postings
from quarry.operators.segments import Segments
from quarry.sources.sinks import exists


def index_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append postings of documents that the index at path has not seen.

    Postings and seen ids are tables of their own, each with a folder for every batch,
    which a repeated batch overwrites; so a batch that failed half-way leaves nothing
    behind, and a look at what was seen reads ids alone.
    """

    def batch(docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        new = docs.dropDuplicates(["doc_id"])
        if exists(spark, f"{path}/seen"):
            seen = spark.read.parquet(f"{path}/seen").where(F.col("batch") != number).select("doc_id")
            new = new.join(seen, "doc_id", "left_anti")
        posted = postings(paragraphs(new), "chunk_id", {"text": "text"})
        posted.withColumn("doc_id", F.substring_index("chunk_id", ":", 1).cast("long")).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        new.select("doc_id").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_segments(stream: DataFrame, path: str, checkpoint: str, columns: dict[str, str] | None = None) -> StreamingQuery:
    """Add the paragraphs of a stream of documents to the segmented index at path.

    Each batch is a segment, and its number is published with it: a batch that failed
    half-way leaves nothing behind, a repeated one changes nothing. A document that comes
    again takes the place of the paragraphs it had, also if it has fewer now.
    """

    def batch(docs: DataFrame, number: int) -> None:
        segments = Segments(docs.sparkSession, path, columns)
        chunks = paragraphs(docs.dropDuplicates(["doc_id"]))
        segments.add(chunks, "chunk_id", note={"stream": checkpoint, "batch": number}, replaced=segments.keys_of(docs.select(F.col("doc_id").cast("string").alias("doc"))))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each type by tumbling window; rows later than the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(spark: SparkSession, source: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame], mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there, and return its result."""
    transform(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
