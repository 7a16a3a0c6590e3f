"""Documents as ordered, linked chunk rows, and the sequence operators over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def paragraphs(docs: DataFrame) -> DataFrame:
    """One row per non-empty line: doc_id, seq (from 1), chunk_id, text, lang, source."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    lines = lines.where(F.length(F.trim("text")) > 0)
    return lines.select("doc_id", (F.col("pos") + 1).alias("seq"), F.concat_ws(":", "doc_id", F.col("pos") + 1).alias("chunk_id"), "text", "lang", "source")


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("seq")


def linked(chunks: DataFrame) -> DataFrame:
    """Neighbours in the document, null at its ends."""
    return chunks.select("*", F.lag("chunk_id").over(_order()).alias("previous_chunk_id"), F.lead("chunk_id").over(_order()).alias("next_chunk_id"))


def surroundings(chunks: DataFrame, focal: DataFrame, window: int = 2) -> DataFrame:
    """The rows within ``window`` places of each focal chunk in its document, labelled before, target or after.

    Only documents with a focal chunk are numbered; focal ids that do not exist give no rows.
    """
    if not 0 <= window <= 8:
        raise ValueError("window must lie in 0..8")
    wanted = focal.select("chunk_id").distinct()
    docs = chunks.join(wanted, "chunk_id", "left_semi").select("doc_id").distinct()
    rows = chunks.join(docs, "doc_id", "left_semi").withColumn("rn", F.row_number().over(_order()))
    targets = rows.join(wanted, "chunk_id", "left_semi").select("doc_id", F.col("chunk_id").alias("target_id"), F.explode(F.sequence(F.col("rn") - window, F.col("rn") + window)).alias("rn"), F.col("rn").alias("rn0"))
    place = F.when(F.col("rn") < F.col("rn0"), "before").when(F.col("rn") > F.col("rn0"), "after").otherwise("target")
    return rows.join(targets, ["doc_id", "rn"]).select("target_id", "chunk_id", "seq", place.alias("position"), "text")


def carried_forward(chunks: DataFrame, heading: Column) -> DataFrame:
    """The last heading at or before each row of its document."""
    return chunks.withColumn("heading", F.last(heading, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)))


def assembled(chunks: DataFrame, separator: str = "\n") -> DataFrame:
    """Texts put together again in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.array_join(parts, separator).alias("text"))


def opening(chunks: DataFrame, n: int = 4, chars: int = 1500) -> DataFrame:
    """The first n chunks of each document, joined by blanks and cut."""
    first = chunks.withColumn("rn", F.row_number().over(_order())).where(F.col("rn") <= n)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return first.groupBy("doc_id").agg(F.substring(F.array_join(parts, " "), 1, chars).alias("opening"))


def split_at(chunks: DataFrame, is_heading: Column) -> DataFrame:
    """Rows grouped from each heading to the next: doc_id, part, n_rows, text."""
    parts = chunks.withColumn("part", F.sum(F.when(is_heading, 1).otherwise(0)).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return parts.groupBy("doc_id", "part").agg(F.count("*").alias("n_rows"), joined.alias("text"))


def suffixed(rows: DataFrame, key: str, order: str, out: str = "unique_id") -> DataFrame:
    """Repeats of a key get _dup1, _dup2, … in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn(out, F.when(n == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_dup"), n.cast("string"))))


def per_group_top(rows: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first k rows of each group in the order, numbered from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def size_stats(chunks: DataFrame, group: str) -> DataFrame:
    """Count, floor mean, upper median and largest size.

    The upper median is the element at n div 2 of the sorted sizes; sizes are counted first, so no group is gathered.
    """
    sizes = chunks.groupBy(group, F.length("text").alias("size")).agg(F.count("*").alias("times"))
    w = Window.partitionBy(group)
    sizes = sizes.select("*", F.sum("times").over(w).alias("n"), F.sum("times").over(w.orderBy("size")).alias("upto"))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("size")))
    return sizes.groupBy(group).agg(F.sum("times").alias("n_chunks"), F.floor(F.sum(F.col("size") * F.col("times")) / F.sum("times")).alias("mean_size"), median.alias("median_size"), F.max("size").alias("max_size"))


def pages(texts: DataFrame) -> DataFrame:
    """Page texts of ``--- PAGE n ---`` delimited documents: doc_id, page, text."""
    marker = r"--- PAGE \d+ ---"
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"--- PAGE (\d+) ---"), F.lit(1)), lambda x: x.cast("int"))
    bodies = F.slice(F.split("text", marker, -1), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    pairs = texts.select("doc_id", F.explode(F.arrays_zip(numbers.alias("page"), bodies.alias("text"))).alias("p"))
    return pairs.select("doc_id", F.col("p.page").alias("page"), F.trim(F.col("p.text")).alias("text")).where("text != ''")
