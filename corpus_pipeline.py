"""A training-corpus pipeline over the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame with the columns of docs; the last returns token digests.
A stage judges rows, not ids: rows
that repeat a doc_id or lack one are told apart. Columns of any name pass through; an
empty table gives an empty result. Stages do not write their results; `run` writes each one as Parquet in the shared
folder and rereads it, so that a later stage never repeats an earlier one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import bpe
from quarry.llm.decontaminate import benchmark_hits
from quarry.llm.exact_dedup import BROADCAST_ROWS, exact_duplicates
from quarry.llm.jaccard_join import similar_documents
from quarry.llm.quality import THRESHOLD, scored, train
from quarry.llm.scratch import release, written
from quarry.session import table


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that names each row by itself, and that column; its order is that of doc_id, null last.

    Where doc_ids are present and unlike, as they should be, it is doc_id. Else rows are
    sorted by doc_id, numbered and written once, so that decisions apply to rows.
    """
    key = _fresh(docs, "row_name")
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return written(docs.orderBy(F.asc_nulls_last("doc_id")).withColumn(key, F.monotonically_increasing_id()), "identified"), key


def _as_documents(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), "text")


def _without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """docs without the rows that are named in dropped's doc_id, and without the naming column."""
    release(docs.sparkSession)
    names = written(dropped.select(F.col("doc_id").alias(key)), "dropped")
    few = names.count() <= BROADCAST_ROWS
    release(docs.sparkSession)
    return docs.join(F.broadcast(names) if few else names, key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier accepts, each row by itself; null and empty texts are scored as well. All stay where there are no labels."""
    release(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    score = _fresh(docs, "quality_score")
    return scored(docs, model, score).where(F.col(score) >= THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal documents: the longest, then that of least doc_id; of rows that repeat a doc_id, one. Null and empty texts are equal."""
    release(spark)
    rows, key = _identified(docs)
    return _without(rows, key, exact_duplicates(_as_documents(rows, key)).where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of least doc_id of each class of near duplicates; texts without words are one class."""
    release(spark)
    rows, key = _identified(docs)
    return _without(rows, key, similar_documents(_as_documents(rows, key)).where("doc_id != class_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a window of a benchmark item; null and empty texts hold none."""
    release(spark)
    rows, key = _identified(docs)
    return _without(rows, key, benchmark_hits(_as_documents(rows, key), table(spark, sf_dir, "benchmark")).where("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left; doc_id, n_tokens and digests of the ids and of the bytes they decode to."""
    release(spark)
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", decontaminate), ("byte-level BPE", tokens)]

#: SQL cannot express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
