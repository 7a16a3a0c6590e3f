"""Vectors: exact inner-product search, anchors, two-stage ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def cosines(vectors: DataFrame, matrix: list[list[float]], column: str = "embedding") -> DataFrame:
    """vectors with a column ``cosines``: the cosine with each row of the matrix, in double precision, null for a null vector.

    A batch of vectors is one matrix product; a vector of another width, or a zero one, gives zeros.
    """
    rows = np.asarray(matrix, float).reshape(len(matrix), -1)
    sizes = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, sizes, out=np.zeros_like(rows), where=sizes > 0)
    at = vectors.columns.index(column)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            n = len(col)
            widths = np.diff(col.offsets.to_numpy())
            usable = np.asarray(col.is_valid()) & (widths == unit.shape[1])
            out = np.zeros((n, len(unit)))
            if usable.any():
                x = col.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, unit.shape[1])
                size = np.linalg.norm(x, axis=1, keepdims=True)
                out[usable] = np.divide(x, size, out=np.zeros_like(x), where=size > 0) @ unit.T
            found = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(unit), pa.int32()), pa.array(out.ravel()), mask=col.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "cosines"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(product, f"{fields}, cosines array<double>")


def cosine_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors of largest cosine with the query: vec_id, score, rank."""
    scored = cosines(vectors.select("vec_id", "embedding"), [query]).select("vec_id", F.get("cosines", F.lit(0)).alias("score"))
    order = (F.desc(F.round("score", 6)), F.asc("vec_id"))
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """The mean vector of each label, as an array in the order of dimensions."""
    each = vectors.select(label, F.posexplode("embedding").alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("anchor"))


def anchor_scores(vectors: DataFrame, anchors: list[tuple[str, list[float]]]) -> DataFrame:
    """Cosine with every anchor, rounded to 4, and the label of the largest unrounded score (first wins)."""
    scores = cosines(vectors, [vector for _, vector in anchors]).withColumnRenamed("cosines", "_s")
    names = F.array(*(F.lit(str(name)) for name, _ in anchors))
    best = F.get(names, (F.array_position("_s", F.array_max("_s")) - 1).cast("int"))
    return scores.select("vec_id", "label", *(F.round(F.get("_s", F.lit(k)), 4).alias(f"score_{name}") for k, (name, _) in enumerate(anchors)), best.alias("best_anchor"))


def group_means(scores: DataFrame, names: list[str], group: str) -> DataFrame:
    """Means rounded to 4 of each score, and the label of the largest rounded mean (first wins)."""
    means = scores.groupBy(group).agg(*(F.round(F.avg(f"score_{n}"), 4).alias(f"mean_{n}") for n in names))
    every = F.array(*(F.col(f"mean_{n}") for n in names))
    best = F.get(F.array(*(F.lit(n) for n in names)), (F.array_position(every, F.array_max(every)) - 1).cast("int"))
    return means.withColumn("best_anchor", best)


def two_stage(scores: DataFrame, prior: Column, bonus: Column) -> DataFrame:
    """0.75 * own + 0.25 * prior where there is a prior, plus 0.15 * bonus; rounded to 4."""
    mixed = F.when(F.coalesce(prior, F.lit(0.0)) > 0, 0.75 * F.col("score") + 0.25 * prior).otherwise(F.col("score"))
    return scores.withColumn("combined", F.round(mixed + 0.15 * F.coalesce(bonus, F.lit(0.0)), 4))
