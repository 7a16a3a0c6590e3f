"""Headers and footers that repeat over the pages of a file, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TOP, BOTTOM, LEAST = 2, 3, 3


def _edges(lines: DataFrame) -> DataFrame:
    a = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    b = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))
    return lines.select("*", a.alias("_a"), b.alias("_b")).where(f"_a <= {TOP} or _b <= {BOTTOM}")


def page_furniture(lines: DataFrame, pages: DataFrame, file: str, share: float = 0.3) -> DataFrame:
    """(file, line, times) of edge lines on at least max(3, share of the file's pages) pages."""
    n = pages.groupBy(file).agg(F.countDistinct("doc_id").alias("pages"))
    times = _edges(lines).groupBy(file, F.trim("text").alias("line")).agg(F.countDistinct("doc_id").alias("times"))
    return times.join(n, file).where(F.col("times") >= F.greatest(F.lit(LEAST), F.floor(F.lit(share) * F.col("pages")))).select(file, "line", "times")


def without_furniture(lines: DataFrame, furniture: DataFrame, file: str) -> DataFrame:
    """Lines that are not furniture of their file."""
    return lines.withColumn("line", F.trim("text")).join(furniture.select(file, "line"), [file, "line"], "left_anti").drop("line")
