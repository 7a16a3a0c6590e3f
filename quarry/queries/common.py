"""Pieces that several query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.chunks import paragraphs
from quarry.session import spread, table

#: SQL for the paragraphs of documents; use as ``WITH p AS (…)``.
PARAGRAPHS = """p AS (
    SELECT doc_id, lang, source, seq, concat(doc_id, ':', seq) AS chunk_id, line AS text
    FROM (SELECT doc_id, lang, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS seq FROM documents)
    WHERE length(trim(line)) > 0)"""

WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, dealt out to all cores where its files make too few tasks."""
    return spread(table(spark, sf_dir, name))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(texts(spark, sf_dir))


class Registry:
    """Collects the queries of a module; the decorator takes the SQL counterpart."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def keep(query: Callable) -> Callable:
            self.queries[query.__name__] = query
            if sql:
                self.oracles[query.__name__] = sql
            return query

        return keep
