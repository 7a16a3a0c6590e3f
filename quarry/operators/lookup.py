"""Lookups with several ways to match, applied to whole tables as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.marks import base_designation


def by_id_or_suffix(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each cited id with the chunk of that id, else the least chunk id with the same part after the last colon (of over two characters)."""
    exact = cited.select("cited").distinct().join(chunks.select(F.col("chunk_id").alias("cited"), F.col("chunk_id").alias("exact_id")), "cited", "left")
    last = lambda c: F.substring_index(c, ":", -1)
    open_ = exact.where("exact_id is null").select("cited", last("cited").alias("tail")).where(F.length("tail") > 2)
    tails = chunks.select("chunk_id", last("chunk_id").alias("tail")).join(open_.select("tail").distinct(), "tail", "left_semi").groupBy("tail").agg(F.min("chunk_id").alias("suffix_id"))
    near = open_.join(tails, "tail").select("cited", "suffix_id")
    return exact.join(near, "cited", "left").select("cited", F.coalesce("exact_id", "suffix_id").alias("chunk_id"), F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("suffix_id").isNotNull(), "suffix").alias("how"))


def by_designation(names: DataFrame, known: DataFrame) -> DataFrame:
    """names.name matched to known.name as written, else by base designation (least id wins)."""
    raw = known.groupBy(F.col("name")).agg(F.min("id").alias("raw_id"))
    base = known.groupBy(base_designation(F.col("name")).alias("base")).agg(F.min("id").alias("base_id"))
    both = names.join(raw, "name", "left").withColumn("base", base_designation(F.col("name"))).join(base, "base", "left")
    return both.select("name", F.coalesce("raw_id", "base_id").alias("id"))


def merged_lists(rows: DataFrame) -> DataFrame:
    """A row that ends with a colon takes in the rows after it up to the next row that is no item.

    Rows are (doc_id, seq, kind, text); the head of each run keeps its seq.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    head = (F.col("kind") != "item") | ~F.coalesce(F.last(F.when(F.col("kind") != "item", F.col("text").endswith(":")), ignorenulls=True).over(w), F.lit(False))
    grouped = rows.withColumn("run", F.sum(head.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return grouped.groupBy("doc_id", "run").agg(F.min("seq").alias("seq"), F.count("*").alias("n_rows"), text.alias("text")).drop("run")


def reconciled(queue: DataFrame, listing: DataFrame, candidates: list) -> DataFrame:
    """Queue rows with the first of their candidate paths that is in the listing (path, valid)."""
    tried = queue.select("id", F.posexplode(F.array(*candidates)).alias("priority", "path"))
    hits = tried.join(listing.where("valid"), "path").groupBy("id").agg(F.min_by("path", "priority").alias("path"))
    return queue.join(hits, "id", "left").withColumn("status", F.when(F.col("path").isNotNull(), "complete").otherwise("pending"))
