"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Each task hashes its rows' normalised texts, sorts the distinct hashes of a
   block and sends them, Golomb-Rice coded, to the owners of the hash ranges.
2. An owner decodes what it got and answers each block with a bitmap of the
   hashes that another block has as well (or the block has twice).
3. Rows whose bit is set are suspects. Only their texts are shuffled, by the
   text itself with map-side aggregation, so that equal bytes decide and a group
   of any size reaches each reducer as one row per task.

Defined results: null text is the empty text; rows that repeat a doc_id count
each in ``group_size``, and ``kept`` is true for every row whose doc_id is the
group's ``keep_id``; a null doc_id keeps its row and loses ties. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytes_np import WHITE
from quarry.llm.scratch import small_batches, written

#: Hashes that one owner answers for, about; and rows in a block.
OWNER_ROWS, BLOCK_ROWS = 400_000, 100_000
#: Rows up to which a table of ids or groups (under 100 bytes a row) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit values as Golomb-Rice coded differences: parameter, count, quotients, remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(gaps.mean())))))
    k = max(k, int(gaps.max()).bit_length() - 20)  # a far first value must not make a long unary part
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    rest = np.zeros((len(gaps), k), np.uint8)
    for b in range(k):
        rest[:, b] = (gaps >> np.uint64(k - 1 - b)) & np.uint64(1)
    quotients = np.packbits(unary).tobytes()
    return bytes([k]) + len(gaps).to_bytes(4, "little") + len(quotients).to_bytes(4, "little") + quotients + np.packbits(rest).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    """The values that rice_encode got."""
    if not code:
        return np.zeros(0, np.uint64)
    k, n, size = code[0], int.from_bytes(code[1:5], "little"), int.from_bytes(code[5:9], "little")
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 9)))[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    rest = np.unpackbits(np.frombuffer(code, np.uint8, -1, 9 + size))[: n * k].reshape(n, k)
    for b in range(k):
        gaps |= rest[:, b].astype(np.uint64) << np.uint64(k - 1 - b)
    return np.cumsum(gaps, dtype=np.uint64)


_SENT = "kind int, block long, owner int, place int, doc_id long, sha binary, code binary"


def _blocks(owner_bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        shas: list[bytes] = []

        def block() -> pa.RecordBatch:
            name = (task << 24) | number
            prints = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)
            order = np.argsort(prints, kind="stable")
            distinct, inverse, times = np.unique(prints[order], return_inverse=True, return_counts=True)
            owners = (distinct >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(distinct), np.int64)
            firsts = np.searchsorted(owners, np.arange((1 << owner_bits) + 1))
            of, place = owners[inverse], inverse - firsts[owners[inverse]]
            rows = {"kind": [0] * len(order), "block": [name] * len(order), "owner": of, "place": place, "doc_id": [ids[i] for i in order], "sha": [shas[i] for i in order], "code": [None] * len(order)}
            sent = {k: [] for k in rows}
            for o in np.unique(owners):
                part = slice(firsts[o], firsts[o + 1])
                twice = np.packbits(times[part] > 1).tobytes()
                for k, v in zip(rows, (1, name, int(o), 0, None, twice, rice_encode(distinct[part]))):
                    sent[k].append(v)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([*rows[k], *sent[k]], t) for k, t in zip(rows, types)], names=list(rows))

        for batch in batches:
            ids += batch.column(0).to_pylist()
            for text in batch.column(1):
                shas.append(hashlib.sha256((text.as_buffer().to_pybytes() if text.is_valid else b"").translate(None, WHITE)).digest())
            if len(ids) >= BLOCK_ROWS:
                yield block()
                ids, shas, number = [], [], number + 1
        if ids:
            yield block()

    return send


def _answer(messages):
    """Of one owner's messages: for each block a bitmap of its hashes that are not unique."""
    import pandas as pd

    lists = [rice_decode(c) for c in messages["code"]]
    every = np.sort(np.concatenate(lists))
    several = np.unique(every[1:][every[1:] == every[:-1]]) if len(every) > 1 else every[:0]
    maps = []
    for values, twice in zip(lists, messages["sha"]):
        if len(several):
            at = np.minimum(np.searchsorted(several, values), len(several) - 1)
            bits = several[at] == values
        else:
            bits = np.zeros(len(values), bool)
        bits |= np.unpackbits(np.frombuffer(twice, np.uint8), count=len(values)).astype(bool)
        maps.append(np.packbits(bits).tobytes())
    return pd.DataFrame({"block": messages["block"], "owner": messages["owner"], "bitmap": maps})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    small_batches(docs.sparkSession)
    n = docs.count()
    owner_bits = max(4, int(max(1, n // OWNER_ROWS)).bit_length())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = written(slim.mapInArrow(_blocks(owner_bits), _SENT), "prints", "kind")
    rows = sent.where("kind = 0").select("block", "owner", "place", "doc_id", "sha")
    maps = sent.where("kind = 1").select("block", "owner", "sha", "code").groupBy("owner").applyInPandas(_answer, "block long, owner int, bitmap binary")
    bit = F.expr("(cast(conv(hex(substring(bitmap, place div 8 + 1, 1)), 16, 10) as int) & shiftright(128, place % 8)) != 0")
    marked = written(rows.join(maps, ["block", "owner"]).select("doc_id", "sha", bit.alias("suspect")), "marked")

    suspects = marked.where("suspect").select(F.col("doc_id").alias("_id")).distinct()
    few = suspects.count() <= BROADCAST_ROWS
    texts = slim.join(F.broadcast(suspects) if few else suspects, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # The longest original text stays, then the smallest doc_id (null last): one decimal orders both, which keeps this a hash aggregation.
    unit, shift = "100000000000000000000BD", "9223372036854775808BD"
    text, code = F.coalesce("text", F.lit("")), F.expr(f"coalesce(cast(doc_id as decimal(20,0)) + {shift}, 2 * {shift})")
    groups = (
        texts.select(F.translate(text, WHITE.decode(), "").alias("bare"), F.char_length(text).alias("length"), code.alias("code"))
        .select("bare", F.expr(f"cast(cast(length as decimal(11,0)) * {unit} + ({unit} - 1 - code) as decimal(38,0))").alias("rank"))
        .groupBy("bare")
        .agg(F.count("*").alias("group_size"), F.max("rank").alias("rank"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("bare", 256)).alias("sha"), "group_size", F.expr(f"{unit} - 1 - rank % {unit} - {shift}").alias("keep"))
    )
    groups = written(groups.select("sha", "group_size", F.expr(f"if(keep = {shift}, null, cast(keep as long)) as keep_id")), "groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return marked.join(groups, "sha", "left").select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
