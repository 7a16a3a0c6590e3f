"""N-gram Jaccard self-join of documents by chosen paths.

Every text is a set of word shingles (five words, ASCII lower-cased; a shorter
text is one shingle). Rows with equal sets are one representative. A set is
embedded as MINS sampled tokens (its least elements under MINS hashes), of which
similar sets share a fraction equal to their Jaccard similarity.

Each of RUNS runs is a tree: a node splits its sets by the token at a coordinate
chosen for that node, one or two coordinates so that a pair at the threshold
keeps one common path on average. Buckets of up to BUCKET sets are compared by
brute force on the embedding; larger ones split again, to a depth that grows with
the number of sets. Runs repeat until pairs at the threshold meet at that depth
with TARGET probability (0.99). Buckets still large at the last level are cut in
blocks, and every pair of blocks is compared in full in a task of its own, of which
only the trees of similar sets leave the task.

Pairs that pass the embedding's generous bound only propose groups. Texts of
proposed groups meet once, and the exact Jaccard similarity of their full
shingle sets decides. A group beyond one task's bound is cut in blocks and each
pair of blocks is a task; counts and local trees leave the tasks, never pairs.

Defined results: null and empty texts have the empty set and are copies of one
another; repeated rows are copies; rows that repeat a doc_id, or have none, are told
apart by their sets; a class without any doc_id has a null class_id; ties break by
the least id; very long texts are sets like others. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytes_np import Words, buffers, fold_table, mix, shingles, slices
from quarry.llm.components import connected_components
from quarry.llm.exact_dedup import BROADCAST_ROWS
from quarry.llm.scratch import release, small_batches, written

SIZE, THRESHOLD, TARGET = 5, 0.8, 0.99
MINS, BUCKET, DEPTH = 64, 32, 5
#: Sets from which each doubling adds a level, and sets in a block of a bucket.
DEPTH_ROWS, BUCKET_BLOCK = 100_000, 2_000
#: Rows up to which the table of classes (over 100 bytes a row, on the driver several times over) is broadcast.
CLASS_ROWS = 100_000
#: Agreement of the embeddings from which a pair is proposed: over three deviations below the threshold.
PROPOSE = 0.62
#: Members and bytes of text of one block of a group.
BLOCK_ROWS, BLOCK_BYTES = 1_000, 4 << 20
_U = np.uint64
_SEEDS = mix(np.arange(1_000, 1_000 + MINS, dtype=_U)) | _U(1)


def survival(depth: int, threshold: float = THRESHOLD) -> float:
    """The chance that a pair at the threshold still shares a path of one run at that depth."""
    two = 1 / threshold - 1  # the chance of a second coordinate, so that 1 / threshold are chosen on average
    lost = 1 - threshold
    for _ in range(depth - 1):
        lost = 1 - threshold + threshold * ((1 - two) * lost + two * lost * lost)
    return 1 - lost


def runs_needed(depth: int = DEPTH, target: float = TARGET, threshold: float = THRESHOLD) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - survival(depth, threshold)))


def _table() -> np.ndarray:
    """White space splits words; A-Z counts as a-z."""
    table = fold_table("plain")
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def sets_of(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and the bounds of the rows."""
    words = Words(*buffers(column), _table())
    rows = len(column)
    hashes, at = shingles(words, size)
    owner = words.row[at]
    short = np.flatnonzero((np.diff(words.bounds) > 0) & (np.diff(words.bounds) < size))
    if len(short):
        whole = np.array([int(mix(np.array([len(h := words.hash[words.bounds[r] : words.bounds[r + 1]])], _U) + (h * _SEEDS[: len(h)]).sum(dtype=_U))[0]) for r in short], _U)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(rows + 1))


def _embedded(size: int):
    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, bounds = sets_of(part.column(1), size)
            rows, full = part.num_rows, np.flatnonzero(np.diff(bounds))
            mins = np.zeros((rows, MINS), np.uint32)
            for k in range(MINS if len(data) else 0):
                mins[full, k] = np.minimum.reduceat(((data * _SEEDS[k]) >> _U(32)).astype(np.uint32), bounds[full])
            ids = _ids(data, bounds)
            size_of = np.diff(np.frombuffer(part.column(1).buffers()[1], np.int32, rows + 1, part.column(1).offset * 4))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(np.diff(bounds)), pa.array(size_of.astype(np.int64)), pa.array([m.tobytes() for m in mins], pa.binary())], names=["doc_id", "set_id", "n", "bytes", "mins"])

    return embed


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), MINS)


def _children(path: np.ndarray, mins: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """New paths of each row below its node, and the row numbers: one coordinate of the node, for some nodes two."""
    h = mix(path.view(_U) ^ _U(0xA5A5A5A5DEADBEEF))
    rows = np.arange(len(path))
    first = (h % _U(MINS)).astype(np.int64)
    second = (first + 1 + ((h >> _U(8)) % _U(MINS - 1)).astype(np.int64)) % MINS
    both = (h >> _U(40)).astype(np.float64) / 2.0**24 < 1 / threshold - 1
    step = lambda r, c: mix(mix(path.view(_U)[r] + c.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ mins[r, c].astype(_U)).view(np.int64)
    r2 = rows[both]
    return np.concatenate([step(rows, first), step(r2, second[both])]), np.concatenate([rows, r2])


def _first_level(runs: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = _matrix(batch.column(1))
            rids = batch.column(0).to_numpy()
            for run in range(runs):
                node = mix(np.array([run + 1], _U))
                c = run % MINS
                path = mix(mix(node) ^ mins[:, c].astype(_U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(rids)], names=["path", "rid"])

    return split


def _next_level(threshold: float):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                path, rows = _children(batch.column(0).to_numpy(), _matrix(batch.column(2)), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(batch.column(1).to_numpy()[rows])], names=["path", "rid"])

    return split


def _runs_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Regroup batches sorted by a column so that no run of equal values is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cut = len(values) - int(np.argmax(values[::-1] != values[-1])) if values[0] != values[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairs_in_buckets(propose: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs_of(batches, 0):
            path, rid, mins = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for lag in range(1, len(path)):
                near = np.flatnonzero(path[lag:] == path[:-lag])
                if not len(near):
                    break
                for at in range(0, len(near), 20_000):
                    i = near[at : at + 20_000]
                    good = i[(mins[i] == mins[i + lag]).mean(1) >= propose]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[good + lag]), pa.array(rid[good])], names=["a", "b"])

    return compare


def depth_of(sets: int) -> int:
    return DEPTH + max(0, math.ceil(math.log2(max(1, sets) / DEPTH_ROWS)))


def _near_in_blocks(propose: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns: task key, side (0 left, 1 right, 2 both), rid, mins.
        for batch in _runs_of(batches, 0):
            task = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
            for x, y in zip(cuts[:-1], cuts[1:]):
                side, rid = batch.column(1).to_numpy()[x:y], batch.column(2).to_numpy()[x:y]
                mins = np.ascontiguousarray(_matrix(batch.column(3).slice(x, y - x)).T)
                left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                link = np.zeros((len(rid), len(rid)), bool)
                for at in range(0, len(left), 256):
                    some = left[at : at + 256]
                    same = np.zeros((len(some), len(right)), np.uint8)
                    for values in mins:
                        same += values[some][:, None] == values[right][None, :]
                    near = same >= propose * MINS
                    link[np.ix_(some, right)] = near
                    link[np.ix_(right, some)] |= near.T
                root = _roots(link)
                good = np.flatnonzero(root != np.arange(len(rid)))
                yield pa.RecordBatch.from_arrays([pa.array(rid[good]), pa.array(rid[root[good]])], names=["a", "b"])

    return compare


def proposed_pairs(reps: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Pairs (a, b) of rid that join all those that share a bucket and agree in their embeddings.

    Each level's small buckets are written, and the embeddings join those of all levels once:
    one plan of all levels has some hundred exchanges, and the driver plans and lists it anew
    after each of them.
    """
    propose = PROPOSE * threshold / THRESHOLD
    slim = reps.select("rid", "mins")
    last = depth_of(slim.count())
    level = slim.mapInArrow(_first_level(runs_needed(last, target, threshold)), "path long, rid long")
    buckets = []

    def pairs_of(tasks: DataFrame, compare) -> DataFrame:
        return written(tasks.repartition("path").sortWithinPartitions("path", "rid").mapInArrow(compare(propose), "a long, b long"), "pairs")

    def in_buckets() -> DataFrame:
        return pairs_of(_union(buckets).join(slim, "rid").select("path", "rid", "mins"), _pairs_in_buckets)

    for depth in range(1, last + 1):
        level = written(level, "level")
        sizes = written(level.groupBy("path").count().where("count > 1"), "sizes")
        buckets.append(written(level.join(sizes.where(f"count <= {BUCKET}"), "path").select("path", "rid"), "buckets"))
        release(reps.sparkSession)
        large = sizes.where(f"count > {BUCKET}")
        if large.isEmpty():
            return in_buckets().distinct()
        rest = level.join(large, "path").select("path", "rid", "count").join(slim, "rid").select("path", "rid", "mins", "count")
        if depth < last:
            level = rest.select("path", "rid", "mins").mapInArrow(_next_level(threshold), "path long, rid long")
    # Every pair of blocks of a bucket, and every block with itself, is a task of its own.
    blocks = F.ceil(F.col("count") / BUCKET_BLOCK).cast("int")
    cut = rest.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rid", "path"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    tasks = cut.select(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"), side.alias("side"), "rid", "mins")
    return in_buckets().union(pairs_of(tasks, _near_in_blocks)).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of each left and right set (indexes into sets) is at least the threshold."""
    every = np.concatenate([left, right]) if left is not right else left
    sizes = np.array([len(s) for s in sets], float)
    tokens = np.concatenate([sets[i] for i in every]) if len(every) else np.zeros(0, _U)
    row = np.repeat(np.arange(len(every)), [len(sets[i]) for i in every])
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    group = np.cumsum(new) - 1
    times = np.bincount(group) if len(group) else np.zeros(0, int)
    keep = times[group] > 1
    column = (np.cumsum(times > 1) - 1)[group[keep]]
    row, width = row[keep], int((times > 1).sum())
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, 4_096):
        part = (column >= at) & (column < at + 4_096)
        x = np.zeros((len(every), min(4_096, width - at)), np.float32)
        x[row[part], column[part] - at] = 1
        both += x[: len(left)] @ (x.T if left is right else x[len(left) :].T)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return (both >= threshold * union - 1e-9) & (union > 0)


def _roots(link: np.ndarray) -> np.ndarray:
    """The least index of each node's component in a symmetric adjacency matrix."""
    label = np.arange(len(link))
    while True:
        least = np.array([label[r].min() if r.any() else len(link) for r in link]) if len(link) else label
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _ids(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit names of sets."""
    import xxhash

    return [xxhash.xxh3_128_digest(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]


def _verified(size: int, threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns: task key, side (0 left, 1 right, 2 both), rid, set_id, text.
        for batch in _runs_of(batches, 0):
            task = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
            out: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                run = batch.slice(a, b - a)
                data, bounds = sets_of(run.column(4), size)
                # Several rows may have the representative's doc_id; only texts of its own set count.
                own = np.array([x == y for x, y in zip(_ids(data, bounds), run.column(3).to_pylist())], bool)
                rid, first = np.unique(run.column(2).to_numpy()[own], return_index=True)
                if len(rid) < 2:
                    continue
                first = np.flatnonzero(own)[first]
                sets = [data[bounds[x] : bounds[x + 1]] for x in first]
                side = run.column(1).to_numpy()[first]
                if side[0] == 2:
                    every = np.arange(len(rid))
                    link = _linked(sets, every, every, threshold)
                    np.fill_diagonal(link, False)
                else:
                    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                    link = np.zeros((len(rid), len(rid)), bool)
                    if len(left) and len(right):
                        across = _linked(sets, left, right, threshold)
                        link[np.ix_(left, right)], link[np.ix_(right, left)] = across, across.T
                out += zip(rid.tolist(), link.sum(1).tolist(), rid[_roots(link)].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["rid", "links", "root"])

    return check


def similar_documents(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), n_links (other texts at the threshold or above), n_copies (rows of the same shingle set)."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(slim.mapInArrow(_embedded(size), "doc_id long, set_id binary, n long, bytes long, mins binary"), "rows")
    reps = rows.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bytes").alias("bytes"), F.first("mins").alias("mins"))
    reps = written(reps.withColumn("rid", F.monotonically_increasing_id()), "reps")
    groups = written(connected_components(proposed_pairs(reps.where("n > 0"), threshold, target)), "groups")

    members = groups.select(F.col("node").alias("rid"), "component").join(reps.select("rid", "set_id", "rep", "bytes"), "rid")
    blocks = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = written(members.join(blocks, "component").select("rid", "component", "blocks", "set_id", F.col("rep").alias("_rep")), "members")
    few = members.count() <= BROADCAST_ROWS
    texts = slim.join(F.broadcast(members) if few else members, F.col("doc_id").eqNullSafe(F.col("_rep")))
    whole = texts.where("blocks = 1").select("component", F.lit(2).alias("side"), "rid", "set_id", "text")
    # A group of several blocks: every pair of its blocks, and every block with itself, is a task of its own.
    mine = F.pmod(F.xxhash64("rid"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = texts.where("blocks > 1").withColumn("mine", mine).withColumn("other", other)
    cut = cut.select(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("component"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "rid", "set_id", "text")
    tasks = whole.union(cut).repartition("component").sortWithinPartitions("component")
    checked = written(tasks.mapInArrow(_verified(size, threshold), "rid long, links long, root long"), "checked")
    release(docs.sparkSession)

    classes = connected_components(checked.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("rid").agg(F.sum("links").alias("n_links"))
    known = reps.select("rid", "set_id", "rep", "copies").join(classes.withColumnRenamed("node", "rid"), "rid", "left").join(links, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = known.groupBy("component").agg(F.min("rep").alias("class_id"))
    known = written(known.join(least, "component").select("set_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies")), "known")
    out = rows.select("doc_id", "set_id").join(F.broadcast(known) if known.count() <= CLASS_ROWS else known, "set_id")
    return out.select("doc_id", "class_id", "n_links", "n_copies")
