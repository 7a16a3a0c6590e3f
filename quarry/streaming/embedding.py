"""Vectors of what is new, by stream or table, in a store whose batches are published whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.columns import normalised
from quarry.sources.snapshots import Snapshots

VECTORS = "id string, embedding array<float>"


class VectorStore:
    """Unit vectors by kind, each id once; a batch that was not published leaves nothing behind."""

    def __init__(self, spark, path: str, embed, prefix: str = "passage: ", most_chars: int = 8_000):
        """``embed`` maps a pandas Series of texts to one of vectors and retries by itself (`sources.sinks.patient`)."""
        self.spark, self.store, self.embed, self.prefix, self.most_chars = spark, Snapshots(spark, path), embed, prefix, most_chars

    def vectors(self, kind: str) -> DataFrame:
        """(id, embedding) of a kind; none before its first batch."""
        base = self.store.pointer()
        return self.store.frame(base["tables"][kind]) if kind in base["tables"] else self.spark.createDataFrame([], VECTORS)

    def add(self, rows: DataFrame, text: Column, kind: str, limit: int | None = None, note: dict | None = None) -> int:
        """Embed rows (id, and more) that the kind lacks, at most ``limit`` of them in the order of their ids; returns the version.

        Null ids are left out, of equal ids one row counts, null texts are empty. A call
        with a limit goes on where the last one ended. ``note`` (stream, batch) makes a
        repeated batch do nothing.
        """
        base = self.store.pointer()
        seen = base["notes"].get("batches", {})
        if note and seen.get(note["stream"], -1) >= note["batch"]:
            return base["version"]
        wanted = rows.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.concat(F.lit(self.prefix), F.substring(F.coalesce(text, F.lit("")), 1, self.most_chars)).alias("text"))
        fresh = wanted.groupBy("id").agg(F.min("text").alias("text"))
        if kind in base["tables"]:
            fresh = fresh.join(self.store.frame(base["tables"][kind]).select("id"), "id", "left_anti")
        if limit is not None:
            fresh = fresh.orderBy("id").limit(limit)
        made = fresh.select("id", F.pandas_udf(self.embed, "array<float>")("text").alias("embedding"))
        unit = made.select("id", F.transform(normalised(F.col("embedding")), lambda x: x.cast("float")).alias("embedding"))
        notes = {"batches": seen | {note["stream"]: note["batch"]}} if note else None
        return self.store.publish({kind: unit}, append=(kind,), notes=notes, base=base)

    def drop(self, kind: str, keys: DataFrame) -> int:
        """Take the vectors of some ids (id) out of a kind; unknown ids change nothing."""
        base = self.store.pointer()
        if kind not in base["tables"]:
            return base["version"]
        return self.store.publish({kind: self.vectors(kind).join(keys.select(F.col("id").cast("string").alias("id")), "id", "left_anti")}, base=base)

    def follow(self, stream: DataFrame, text: Column, kind: str, checkpoint: str) -> StreamingQuery:
        """Embed a stream of rows (id, and more) as it comes; each batch is published with its number."""

        def batch(rows: DataFrame, number: int) -> None:
            self.add(rows, text, kind, note={"stream": checkpoint, "batch": number})

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
