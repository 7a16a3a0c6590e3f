"""Merkle manifest of a table: postorder append logs written by aligned builders.

A tree of WIDTH children a node stands over the rows of each group, and one more over
the groups' roots. Rows are ranked inside their group by a range-partitioned sort;
a builder takes WIDTH ** BUILDER_LEVELS consecutive inputs, aligned, so that its nodes are
a whole subtree, and appends each node as soon as its children are complete. The
builders' roots are the inputs of the next pass, until each tree has one builder.

The log needs no index: the place of a node follows from the sizes of the subtrees
before it (`position`), and so do the places of its siblings. Proofs are cut from the
logs top-down, the upper part of a path once for each builder.

Digests are lowercase hex SHA-256 of the children's digests, concatenated; a last run of
fewer than WIDTH, even one, is hashed as well, and a tree of one input is that input.

Defined results: null fields count as `-`, apart from an empty text; null groups come
first, as do null ids inside a group; rows that repeat an id are ordered by their leaf,
equal rows are leaves of their own; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.scratch import small_batches, written

WIDTH, BUILDER_LEVELS = 8, 3
#: Rows up to which a table of groups or partitions (under 100 bytes a row) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n inputs."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def position(level: int, index: np.ndarray, n: int, levels: int) -> np.ndarray:
    """Places in the log of the nodes `index` of a level: how many nodes are complete before them, in a tree of n inputs."""
    before = index.copy()
    for k in range(level):
        before += np.minimum(-(-n // WIDTH**k), (index + 1) * WIDTH ** (level - k))
    for up in range(1, levels - level + 1):
        before += index // WIDTH**up
    return before


def completed(inputs: list[str], levels: int) -> list[str]:
    """The log of a tree: its nodes in the order in which they are complete."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(levels)]

    def add(level: int, node: str) -> None:
        log.append(node)
        if level < levels:
            open_runs[level].append(node)
            if len(open_runs[level]) == WIDTH:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        add(level + 1, digest("".join(run)))

    for node in inputs:
        add(0, node)
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return log


_SEGMENT = "tree string, builder long, n long, size int, levels int, log binary, root string, ids array<long>, changed array<string>"


def _built(builder_levels: int):
    def build(rows: pa.Table) -> pa.Table:
        """One builder: its log, and the ids and changed leaves of its inputs in their order."""
        rows = rows.sort_by("rank")
        n, inputs = rows.column("n")[0].as_py(), rows.column("digest").to_pylist()
        levels = min(height(n), builder_levels)
        log = completed(inputs, levels)
        return pa.table(
            {
                "tree": rows.column("tree").slice(0, 1).combine_chunks(), "builder": rows.column("builder").slice(0, 1).combine_chunks(), "n": pa.array([n], pa.int64()), "size": pa.array([len(inputs)], pa.int32()), "levels": pa.array([levels], pa.int32()),
                "log": pa.array([bytes.fromhex("".join(log))], pa.binary()), "root": pa.array([log[-1]]), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), "changed": pa.array([rows.column("changed").to_pylist()], pa.list_(pa.string())),
            }
        )

    return build


def paths(log: bytes, size: int, levels: int, above: list[str]) -> tuple[list[str], list[list[str]]]:
    """The inputs of a log, and of each the left and right siblings level by level, with `above` behind them."""
    text = log.hex()
    sides = [above]
    nodes: list[str] = []
    for level in range(levels, -1, -1):
        at = position(level, np.arange(-(-size // WIDTH**level)), size, levels)
        nodes = [text[64 * p : 64 * p + 64] for p in at.tolist()]
        if level < levels:
            sides = [["".join(nodes[i - i % WIDTH : i]), "".join(nodes[i + 1 : i - i % WIDTH + WIDTH]), *sides[i // WIDTH]] for i in range(len(nodes))]
    return nodes, sides


def fold(leaf: str, sides: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    return reduce(lambda x, k: digest(sides[k] + x + sides[k + 1]), range(0, len(sides), 2), leaf)


def _tails(span: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each input of a segment of a higher pass: its path up to the root."""
        for batch in batches:
            for row in batch.to_pylist():
                _, sides = paths(row["log"], row["size"], row["levels"], row["sides"])
                first = row["builder"] * span
                n = len(sides)
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n), pa.array(np.arange(first, first + n)), pa.array(sides, pa.list_(pa.string()))], names=["tree", "builder", "sides"])

    return cut


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            leaves, sides = paths(row["log"], row["size"], row["levels"], row["sides"])
            n, root = len(leaves), row["top"]
            proofs = [digest("".join(s)) for s in sides]
            folded = [fold(x or leaf, s) for x, leaf, s in zip(row["changed"], leaves, sides)]
            columns = [pa.array(row["ids"], pa.int64()), leaves, [row["root"]] * n, [root] * n, proofs, folded, [x == root for x in folded]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, id, digest, changed): the leaf of each row and, where its text is tampered with, the leaf of what it then is."""
    head = [_field(F.col(c)) for c in _FIELDS[:-1]]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("id"), F.sha2(F.concat(*head, _field(F.col("text"))), 256).alias("digest"),
        F.when(hit, F.sha2(F.concat(*head, _field(lower)), 256)).alias("changed"),
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank (from 0) inside their tree by the order's columns, null first, and n, the rows of the tree.

    Range partitions of (tree, order) are sorted; how many rows of a tree lie in earlier
    partitions is added up over one row for each tree and partition.
    """
    keys = ["tree", *order, "tie"]
    low = (1 << 33) - 1
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("place", F.monotonically_increasing_id())
    placed = written(placed.select("*", F.shiftright("place", 33).alias("part")), "ranked")
    firsts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min(F.col("place").bitwiseAND(F.lit(low))).alias("first"))
    so_far = Window.partitionBy("tree").orderBy("part")
    firsts = firsts.select("tree", "part", (F.sum("rows").over(so_far) - F.col("rows") - F.col("first")).alias("add"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    firsts = written(firsts, "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    return placed.join(firsts, ["tree", "part"]).withColumn("rank", F.col("place").bitwiseAND(F.lit(low)) + F.col("add")).drop("part", "place", "add")


class Manifest:
    """The logs of the trees over (tree, id, digest, changed, rank, n), one table for each pass."""

    def __init__(self, inputs: DataFrame, name: str, builder_levels: int = BUILDER_LEVELS):
        self.span = span = WIDTH**builder_levels
        most = inputs.agg(F.max("n")).first()[0] or 0
        self.passes: list[DataFrame] = []
        while not self.passes or most > 1:
            logs = written(inputs.withColumn("builder", F.expr(f"rank div {span}")).groupBy("tree", "builder").applyInArrow(_built(builder_levels), _SEGMENT), name)
            self.passes.append(logs)
            most = -(-most // span)
            inputs = logs.where(f"n > {span}").select("tree", F.col("builder").alias("rank"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("changed"))

    def roots(self) -> DataFrame:
        """(tree, root) of every tree."""
        return reduce(DataFrame.union, (p.where(f"n <= {self.span}").select("tree", "root") for p in self.passes))

    def located(self, tops: DataFrame) -> DataFrame:
        """The first pass's segments with `sides`, the path from their root to the top, and their tree's root; tops: (tree, sides, top)."""
        tops = F.broadcast(tops) if tops.count() <= BROADCAST_ROWS // 20 else tops
        tails = None
        for k in range(len(self.passes) - 1, -1, -1):
            logs = self.passes[k]
            whole = logs.where(f"n <= {self.span}").join(tops.select("tree", "sides"), "tree")
            if tails is not None:
                whole = whole.unionByName(logs.where(f"n > {self.span}").join(tails, ["tree", "builder"]))
            if k:
                tails = written(whole.select("tree", "builder", "size", "levels", "log", "sides").mapInArrow(_tails(self.span), "tree string, builder long, sides array<string>"), "tails")
        return whole.drop("root").join(self.roots(), "tree").join(tops.select("tree", "top"), "tree")


def manifest(docs: DataFrame, builder_levels: int = BUILDER_LEVELS) -> tuple[Manifest, Manifest]:
    """The logs over the rows of each language, and those over the languages' roots."""
    hashed = written(leaves(docs), "leaves")  # a range partitioning reads its input twice, and texts are to be read once
    rows = Manifest(ranked(hashed, ["id", "digest"]), "row_logs", builder_levels)
    groups = rows.roots().select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest"))
    named = written(ranked(groups, ["group"]), "groups").withColumns({"id": F.col("rank"), "changed": F.col("group")})
    return rows, Manifest(named, "group_logs", builder_levels)


def attested(docs: DataFrame, builder_levels: int = BUILDER_LEVELS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    small_batches(docs.sparkSession)
    rows, top = manifest(docs, builder_levels)
    ends = top.roots().select("tree", "root", F.array().cast("array<string>").alias("sides"), F.col("root").alias("top"))
    tops = written(top.located(ends).mapInArrow(_group_paths, "tree string, sides array<string>, top string"), "tops")
    return rows.located(tops).mapInArrow(_proved, _PROVED)


def _group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group: its path up to the root."""
    for batch in batches:
        for row in batch.to_pylist():
            _, sides = paths(row["log"], row["size"], row["levels"], row["sides"])
            yield pa.RecordBatch.from_arrays([pa.array(row["changed"]), pa.array(sides, pa.list_(pa.string())), pa.array([row["top"]] * len(sides))], names=["tree", "sides", "top"])
