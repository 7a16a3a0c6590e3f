"""Tables and reports on disk. Spark's committers make every write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions.columns import normalised


def append_vectors(rows: DataFrame, path: str, kind: str) -> None:
    """Append unit vectors (id, embedding) under their kind; ids that the kind already has are left out, so a repeated run adds nothing."""
    unit = rows.dropDuplicates(["id"]).select("id", F.transform(normalised(F.col("embedding")), lambda x: x.cast("float")).alias("embedding"), F.lit(kind).alias("kind"))
    held = stored_vectors(rows.sparkSession, path, kind)
    if held is not None:
        unit = unit.join(held.select("id"), "id", "left_anti")
    unit.write.mode("append").partitionBy("kind").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def stored_vectors(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame | None:
    """The stored vectors (id, embedding, kind), or None before the first write."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def embed_absent(rows: DataFrame, text: Column, embed, path: str, kind: str, prefix: str = "passage: ", most: int = 8_000) -> DataFrame:
    """Embed what the store lacks: rows (id, and more) by a pandas UDF over prefixed, cut texts; returns what was new.

    ``embed`` maps a pandas Series of texts to one of vectors; it retries by itself.
    """
    held = stored_vectors(rows.sparkSession, path, kind)
    fresh = rows if held is None else rows.join(held.select("id"), "id", "left_anti")
    made = fresh.select("id", F.concat(F.lit(prefix), F.substring(F.coalesce(text, F.lit("")), 1, most)).alias("text")).select("id", F.pandas_udf(embed, "array<float>")("text").alias("embedding"))
    append_vectors(made, path, kind)
    return stored_vectors(rows.sparkSession, path, kind)


def patient(embed_batch, width: int, batch: int = 10, shorter: int = 4_000):
    """A function from a Series of texts to vectors that survives failures: all at once, then ``batch`` at a time, then single shorter texts, then zeros."""
    import pandas as pd

    def tried(texts: list[str]) -> list | None:
        try:
            return list(embed_batch(texts))
        except Exception:  # whatever the model raises
            return None

    def embed(texts: pd.Series) -> pd.Series:
        every, out = texts.tolist(), []
        if (whole := tried(every)) is not None:
            return pd.Series(whole)
        for k in range(0, len(every), batch):
            part = every[k : k + batch]
            vectors = tried(part)
            out += vectors if vectors is not None else [(tried([t[:shorter]]) or [[0.0] * width])[0] for t in part]
        return pd.Series(out)

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return embed


def json_documents(rows: DataFrame, path: str) -> None:
    """One JSON object a line, replacing what was there."""
    rows.write.mode("overwrite").json(path)


def manifest(docs: DataFrame) -> DataFrame:
    """One row of JSON: totals, and the list of documents (doc_id, title, n_chunks, n_words) by id. For catalogues, not for corpora: the list is one value."""
    entries = F.array_sort(F.collect_list(F.struct("doc_id", "title", "n_chunks", "n_words")))
    return docs.agg(F.to_json(F.struct(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), entries.alias("list"))).alias("manifest"))


def extraction_reports(files: DataFrame, path: str) -> None:
    """CSV and JSON lines of all files, and CSV of those that did not pass (status, reasons, and more)."""
    flat = files.select(*(F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in files.dtypes))
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/all_csv")
    files.write.mode("overwrite").json(f"{path}/all_json")
    flat.where("status != 'PASS'").write.mode("overwrite").option("header", True).csv(f"{path}/follow_up")


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))


def file_roll_up(pages: DataFrame) -> DataFrame:
    """Of each file (path): pages, characters, words, share of pages with text, and the mean recognition confidence of recognised pages only."""
    return pages.groupBy("path").agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"),
        F.round(F.avg((F.coalesce("n_chars", F.lit(0)) > 0).cast("double")), 4).alias("text_share"), F.count_if("recognised").alias("recognised_pages"), F.round(F.avg(F.when(F.col("recognised"), F.col("confidence"))), 2).alias("confidence"),
    )


def summary(lines: list[tuple[str, DataFrame]]) -> str:
    """A text report of one-row frames: a title and ``name: value`` lines for each. Only for reports of a few values."""
    out = []
    for title, frame in lines:
        row = frame.first()
        out += [title, "-" * len(title), *(f"{c}: {row[c]}" for c in frame.columns), ""]
    return "\n".join(out)


def dropped(spark: SparkSession, paths: list[str]) -> list[str]:
    """Delete tables by path; returns those that existed. Meant for resets, so paths must be given one by one."""
    gone = []
    for path in paths:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True):
            gone.append(path)
    return gone


class Catalog:
    """A table kept in executors' storage for a time; after that, or after a flush, the next use reads it anew."""

    def __init__(self, read, seconds: float = 600.0, clock=None):
        import time

        self.read, self.seconds, self.clock = read, seconds, clock or time.monotonic
        self.frame, self.since = None, 0.0

    def get(self) -> DataFrame:
        if self.frame is None or self.clock() - self.since > self.seconds:
            self.flush()
            self.frame, self.since = self.read().persist(), self.clock()
        return self.frame

    def flush(self) -> None:
        if self.frame is not None:
            self.frame.unpersist()
            self.frame = None
