"""Stateful folds over the ordered paragraphs of one page: word-budget packing and merging of small rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def packed(paragraphs: Column, target: int = 350, most: int = 600) -> Column:
    """Paragraphs joined in order until ``target`` words; a piece never grows beyond ``most`` unless one paragraph does."""
    n = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("words"))

    def step(a: Column, p: Column) -> Column:
        full = (a["words"] > 0) & (a["words"] + n(p) > most)
        done = F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        text = F.when(full | (a["words"] == 0), p).otherwise(F.concat(a["open"], F.lit("\n\n"), p))
        words = F.when(full, n(p)).otherwise(a["words"] + n(p))
        flush = words >= target
        return F.struct(F.when(flush, F.concat(done, F.array(text))).otherwise(done).alias("done"), F.when(flush, F.lit("")).otherwise(text).alias("open"), F.when(flush, F.lit(0)).otherwise(words).alias("words"))

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["words"] > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def small_merged(pieces: Column, least: int = 30) -> Column:
    """A piece of fewer words than ``least`` joins its predecessor."""
    n = lambda t: F.size(F.split(t, r"\s+"))
    empty = F.array().cast("array<string>")

    def step(a: Column, p: Column) -> Column:
        last = F.element_at(a, -1)
        return F.when((F.size(a) > 0) & (n(p) < least), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), p)))).otherwise(F.concat(a, F.array(p)))

    return F.aggregate(pieces, empty, step)


def page_chunks(pages: DataFrame, target: int = 350, most: int = 600, least: int = 30) -> DataFrame:
    """(doc_id, page, piece, text) of page texts cut at empty lines, packed and merged."""
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    pieces = small_merged(packed(paragraphs, target, most), least)
    return pages.select("doc_id", "page", F.posexplode(pieces).alias("piece", "text"))
