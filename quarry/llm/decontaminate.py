"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of an item (all of a shorter item). Its
shingles of up to three words are ordered by how rare they are in the corpus;
as all of a window must be found, its prefix is the one rarest shingle. A
document word position joins a window if it holds that shingle; the shingle's
place in the window and the text's length bound where the window could lie, and
the words there are compared one by one.

The documents are read twice, once to count the benchmark's own shingles and
once to find candidates, which tasks select with a filter of the prefix hashes;
only these few positions, each with the words around it, enter the join.

Defined results: null and empty texts have no words and are not hit; repeated
items count one by one by their item_id; a repeated document row gets its own
result; null item_ids count but do not show in ``items_sha256``. Columns other
than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.bytes_np import Words, buffers, fold_table, shingles, slices
from quarry.llm.scratch import small_batches, written

SHINGLE = 3
#: Windows up to which their table is broadcast (some 200 bytes each); above, the join shuffles both sides.
BROADCAST_WINDOWS = 200_000
#: Bits of the task-side filter at most (32 MB); it only saves rows, so a fuller one stays right.
FILTER_BITS = 28
_SEED = np.int64(-7046029254386353131)


def _windows(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("words")
        for part in slices(batches):
            data, ends = buffers(part.column(1))
            words = Words(data, ends, table)
            spans = {k: dict(zip(at.tolist(), h.view(np.int64).tolist())) for k in range(1, SHINGLE + 1) for h, at in [shingles(words, k)]}
            out: dict[str, list] = {"item_id": [], "words": [], "hashes": []}
            for row, item in enumerate(part.column(0).to_pylist()):
                a, b = int(words.bounds[row]), int(words.bounds[row + 1])
                n = min(size, b - a)
                k = min(SHINGLE, n)
                for at in range(a, b - n + 1) if n else ():
                    out["item_id"].append(item)
                    out["words"].append([words.text(i) for i in range(at, at + n)])
                    out["hashes"].append([spans[k][i] for i in range(at, at + n - k + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.int64()), pa.array(out["words"], pa.list_(pa.binary())), pa.array(out["hashes"], pa.list_(pa.int64()))], names=list(out))

    return cut


def _members(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Filter of 2**bits bits with one bit set for each hash."""
    flags = np.zeros(1 << bits, bool)
    flags[(hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(flags)


def _probe(packed: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _counts(packed, bits: int, sizes: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("words")
        filtered = packed.value
        for part in slices(batches):
            words = Words(*buffers(part.column(0)), table)
            found = [h[_probe(filtered, bits, h)] for k in sizes for h, _ in [shingles(words, k)]]
            values, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], names=["token", "times"])

    return count


def _candidates(packed, bits: int, sizes: list[int], size: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("words")
        filtered = packed.value
        for part in slices(batches):
            words = Words(*buffers(part.column(2)), table)
            n_words = np.diff(words.bounds)
            rows = part.num_rows
            out = [[part.column(0).to_numpy(zero_copy_only=False)], part.column(1).to_pylist(), n_words.tolist(), [None] * rows, [None] * rows, [None] * rows, [None] * rows]
            keys, ids = part.column(0).to_pylist(), out[1][:]
            out[0] = keys[:]
            tokens = [int(k) for k in keys]  # rows without a candidate are spread by their key
            for k in sizes:
                hashes, at = shingles(words, k)
                hit = _probe(filtered, bits, hashes)
                for token, i in zip(hashes[hit].view(np.int64).tolist(), at[hit].tolist()):
                    row = int(words.row[i])
                    first, last = int(words.bounds[row]), int(words.bounds[row + 1])
                    a, b = max(first, i - size + 1), min(last, i + size)
                    for column, value in zip(out, (keys[row], ids[row], int(n_words[row]), i - first, i - a, [words.text(j) for j in range(a, b)], k)):
                        column.append(value)
                    tokens.append(token)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int32())
            names = ("row_key", "doc_id", "n_words", "at", "before", "near", "k")
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), pa.array(tokens, pa.int64())], names=[*names, "token"])

    return find


def benchmark_hits(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    cut = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartition(8).mapInArrow(_windows(size), "item_id long, words array<binary>, hashes array<long>")
    windows = written(cut, "windows")
    tokens = windows.select(F.explode("hashes").alias("token")).distinct()
    n_tokens, sizes = tokens.count(), [r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect()]
    bits = min(FILTER_BITS, max(16, (n_tokens * 32).bit_length()))
    texts = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def filter_of(hashes: DataFrame):
        """OR of the tasks' filters: at most 2**bits bits, whatever the benchmark's size."""
        make = lambda batches: (pa.RecordBatch.from_arrays([pa.array([_members(b.column(0).to_numpy(), bits).tobytes()])], names=["part"]) for b in batches if b.num_rows)
        packed = np.zeros((1 << bits) >> 3, np.uint8)
        for part in hashes.coalesce(8).mapInArrow(make, "part binary").toLocalIterator():
            packed |= np.frombuffer(part[0], np.uint8)
        return spark.sparkContext.broadcast(packed)

    counted = texts.select("text").mapInArrow(_counts(filter_of(tokens), bits, sizes), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    rarity = written(tokens.join(counted, "token", "left").select("token", F.coalesce("times", F.lit(0)).alias("times")), "rarity")
    key = F.xxhash64("words", "item_id")
    each = windows.withColumn("window", key).select("item_id", "words", "window", F.posexplode("hashes").alias("offset", "token"))
    rarest = Window.partitionBy("window", "item_id").orderBy("times", "token", "offset")
    prefix = each.join(rarity, "token").withColumn("rank", F.row_number().over(rarest)).where("rank = 1").select("item_id", "words", "offset", "token")
    prefix = written(prefix, "prefix")
    n_windows = prefix.count()

    found = texts.mapInArrow(_candidates(filter_of(prefix.select("token").distinct()), bits, sizes, size), "row_key long, doc_id long, n_words long, at int, before int, near array<binary>, k int, token long")
    joined = found.join(F.broadcast(prefix) if n_windows <= BROADCAST_WINDOWS else prefix, "token", "left")
    start, length = F.col("at") - F.col("offset"), F.size("words")
    fits = F.col("near").isNotNull() & (F.col("before") >= F.col("offset")) & (start + length <= F.col("n_words"))
    same = F.expr("slice(near, before - offset + 1, size(words)) = words")
    # A window lies at a start or not: the pairs of a document are distinct (start, length) and distinct items.
    checked = joined.select("row_key", "doc_id", "n_words", F.when(fits & same, F.struct(start.alias("s"), (start + length).alias("e"))).alias("span"), F.when(fits & same, F.col("item_id")).alias("item"))
    per_doc = checked.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("item").alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return per_doc.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (covered > 0).alias("contaminated"))
