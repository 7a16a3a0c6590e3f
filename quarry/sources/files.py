"""Files of documents as rows: JSON documents, chunk files, page texts, feeds, payloads, hashes.

Spark lists and reads the files; what does not parse becomes a row with an error or is
dropped where a function says so.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarry.sources.xml_docs import PARSE_ERRORS


def first_found(spark: SparkSession, name: str, folders: list[str]) -> DataFrame:
    """(path, content) of the file of that name in the first of several folders that has it; no row if none has."""
    found = None
    for k, folder in enumerate(folders):
        rows = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "false").load(folder).select("path", "content", F.lit(k).alias("_n"))
        found = rows if found is None else found.unionByName(rows)
    return found.orderBy("_n").limit(1).drop("_n")


def chunk_files(spark: SparkSession, path: str, chunk: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, unreadable) of JSON files {document_id, title, chunks: [chunk]}: ``chunk`` is the schema of one chunk."""
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("chunks", T.ArrayType(T.StructType.fromDDL(chunk))), T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).withColumn("path", F.input_file_name())
    good = rows.where("_bad is null and chunks is not null")
    return good.select("path", "document_id", "title", F.posexplode("chunks").alias("seq", "chunk")).select("path", "document_id", "title", "seq", "chunk.*"), rows.where("_bad is not null or chunks is null").select("path")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, text) of all text files below a folder but those whose name begins with an underscore; decoded leniently."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return rows.where(~F.startswith(name, F.lit("_"))).select("path", F.regexp_replace(name, r"\.txt$", "").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(path, title, url) of the items of RSS feeds (path, content); a feed that does not parse gives none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    items = E.fromstring(content).iter("item")
                    out += [(path, (i.findtext("title") or "").strip(), (i.findtext("link") or "").strip()) for i in items]
                except PARSE_ERRORS:
                    continue
            yield pd.DataFrame(out, columns=["path", "title", "url"])

    return feeds.select("path", "content").mapInPandas(parse, "path string, title string, url string").where("url != ''")


def xml_payload(content: bytes | None) -> bytes | None:
    """A payload's XML: itself, or the largest XML member of a ZIP that is not a table of contents or a wrapper; null if there is none."""
    if not content:
        return None
    if content.lstrip()[:1] == b"<":
        return content
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = [m for m in z.infolist() if m.filename.lower().endswith(".xml") and not m.filename.lower().endswith((".doc.xml", ".toc.xml"))]
            return z.read(max(members, key=lambda m: (m.file_size, m.filename))) if members else None
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):  # damaged, encrypted, or packed in an unknown way
        return None


def payloads(rows: DataFrame) -> DataFrame:
    """rows (content, and more) with ``xml``, the XML that each payload holds or null."""

    @F.pandas_udf("binary")
    def of(content: pd.Series) -> pd.Series:
        return content.map(xml_payload)

    return rows.withColumn("xml", of("content"))


def hashed(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def relevant_titles(headers: DataFrame, patterns: list[str]) -> DataFrame:
    """Headers (title, and more) with ``keywords``, only those whose title has any."""
    from quarry.functions.acts import keywords

    return headers.withColumn("keywords", keywords(F.col("title"), patterns)).where(F.size("keywords") > 0)


def carried_date(parts: DataFrame, seen: Column) -> DataFrame:
    """parts (path, ord, and more) with ``revised``: the last date seen before or at each row of its file."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("revised", F.last(seen, ignorenulls=True).over(w))
