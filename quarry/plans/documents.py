"""Documents made by hand, notes, context blocks, and tables kept on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.text import embedding_text, slug
from quarry.operators.chunks import linked, suffixed, surroundings

SECTIONS = "section_number string, title string, text string"


def manual_document(spark: SparkSession, title: str, sections: list[dict], document_id: str | None = None, **fields: str) -> tuple[DataFrame, DataFrame]:
    """(document, chunks) of a document given section by section; chunk ids are slugs, repeats get a number."""
    if len(title) < 3 or not sections:
        raise ValueError("a title of three characters and a section are needed")
    meta = {"source": "Manual", "language": "eng", "date": "", "stakeholder": "general", "description": ""} | fields
    doc = spark.createDataFrame([(document_id or title, title, *meta.values())], f"document_id string, title string, {', '.join(f'{k} string' for k in meta)}").withColumn("document_id", slug("document_id"))
    rows = spark.createDataFrame([(k, s.get("section_number", ""), s.get("title", ""), s["text"]) for k, s in enumerate(sections)], f"seq int, {SECTIONS}")
    rows = rows.crossJoin(F.broadcast(doc.select(F.col("document_id").alias("doc_id"), F.col("title").alias("doc_title"))))  # one document
    key = F.concat(F.col("doc_id"), F.lit(":sec_"), F.lower(F.regexp_replace(slug(F.coalesce(F.nullif("section_number", F.lit("")), "title")), r"[.\-]", "_")))
    chunks = suffixed(rows.withColumn("key", key), "key", "seq", "chunk_id").withColumn("embedding_text", embedding_text(F.col("doc_title"), F.concat_ws(" ", "section_number", "title"), F.col("text")))
    return doc.withColumn("chunk_count", F.lit(len(sections))), linked(chunks.drop("key", "doc_title"))


def context_blocks(chunks: DataFrame, hits: DataFrame, window: int = 1, chars: int = 300) -> DataFrame:
    """One prompt block for each hit (chunk_id, rank): its neighbourhood in order, and an excerpt."""
    near = surroundings(chunks, hits, window)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    blocks = near.groupBy("target_id").agg(text.alias("context"), F.max(F.when(F.col("position") == "target", F.substring("text", 1, chars))).alias("excerpt"))
    out = hits.join(blocks, F.col("chunk_id") == F.col("target_id"))
    return out.select("rank", "chunk_id", "excerpt", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "chunk_id", F.lit("\n"), "context").alias("block"))


def replace_documents(rows: DataFrame, path: str, key: str = "doc_bucket") -> None:
    """Overwrite only the partitions of a table that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def compact(spark: SparkSession, path: str, to: str, files: int) -> None:
    """Rewrite a table as a given number of files."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(to)


def routed_json(rows: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines, one folder for each value."""
    rows.write.mode("overwrite").partitionBy(by).json(path)
