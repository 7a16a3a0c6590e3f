"""Language-model scores by prediction by partial matching over bytes.

The model is a byte-context trie of the training rows: counts of every symbol
after every context of up to ORDER bytes, of all orders, gathered from all
training texts. A symbol not seen after a context escapes to the next shorter
one with the chance distinct / (total + distinct), and the symbols that the
longer context offered are excluded there; below order 0 the rest is uniform.
A text's score adds the log10 chance of each of its bytes (A-Z lower-cased) and
of its end, after a start marker; 0xFF, which no UTF-8 text holds, is both.

What is broadcast is bounded and only a cache: the chances of the MODEL_GRAMS most
frequent nodes of the longest contexts, the nodes of orders 0 and 1 (at most 65,792)
and TABLE_WORDS words. Other grams and words of a row are written as distinct
values with their number and joined with the full tables, so scores do not depend
on the bounds. The trie is cut by the two bytes before the symbol: such a part has
all nodes of orders 2 and above that its grams need.

Defined results: null and empty texts have their end only; repeated rows train
and score one by one; an empty or wholly held-out table gives uniform chances.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.bytes_np import buffers, slices
from quarry.llm.scratch import small_batches, written

ORDER, MODEL_GRAMS, TABLE_WORDS = 5, 700_000, 120_000
#: Distinct words or grams a task holds before it passes them on.
HELD = 500_000
#: Distinct grams of a part of the trie, on average.
PART_GRAMS = 250_000
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every byte and end of a slice as one packed integer each, and the bounds of the rows."""
    data, ends = buffers(column)
    rows, sizes = len(ends) - 1, np.diff(ends)
    stream = np.full(len(data) + rows * (ORDER + 1) + ORDER, 0xFF, np.uint8)
    row = np.repeat(np.arange(rows), sizes)
    stream[np.arange(len(data)) + row * (ORDER + 1) + ORDER] = _FOLD[data]
    packed = np.zeros(len(stream) - ORDER, _U)
    for k in range(ORDER + 1):
        packed = (packed << _U(8)) | stream[k : k + len(packed)]
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    # Each row has its bytes and one end in the stream, then the next row's start marker.
    at = np.arange(bounds[-1]) + np.repeat(np.arange(rows) * ORDER, sizes + 1)
    return packed[at], bounds


def _tally(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, times = values[order], times[order]
    firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(firsts, len(values))) if times is None else (np.add.reduceat(times, firsts) if len(values) else times)
    return values[firsts], counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams and words of a task: gram, word, n; one of the two is null."""
    words: Counter = Counter()
    grams: list[tuple] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        values, times = _tally(*(np.concatenate(x) for x in zip(*grams))) if grams else (np.zeros(0, _U), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.nulls(len(values), pa.binary()), pa.array(times.astype(np.int64))], names=["gram", "word", "n"])
        keys = list(words)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array([words[k] for k in keys], pa.int64())], names=["gram", "word", "n"])

    for part in slices(batches):
        grams.append(_tally(grams_of(part.column(0))[0]))
        data, ends = buffers(part.column(0))
        raw = _FOLD[data].tobytes()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            words.update(raw[a:b].split())
        if len(grams) >= 8:
            grams = [_tally(*(np.concatenate(x) for x in zip(*grams)))]
        if len(words) > HELD or len(grams[0][0]) > HELD * 4:
            yield from flushed()
            words, grams = Counter(), []
    yield from flushed()


class Trie:
    """Log10 chances from the counts of each order: {order: (packed context and symbol, count)}."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.grams, self.n, self.contexts, self.total, self.distinct, self.shared, self.mass = {}, {}, {}, {}, {}, {}, {}
        for k in range(ORDER + 1):
            values, times = counts.get(k, (np.zeros(0, _U), np.zeros(0)))
            by = np.argsort(values)
            self.grams[k], self.n[k] = values[by], times[by].astype(float)
            context = self.grams[k] >> _U(8)
            firsts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
            add = lambda x, f=firsts: np.add.reduceat(x, f) if len(f) else np.zeros(0)
            self.contexts[k], self.total[k], self.distinct[k] = context[firsts], add(self.n[k]), add(np.ones(len(context)))
            # What a context's symbols weigh one order below, where they are excluded.
            below = self._count(k - 1, self.grams[k] & _mask(k)) if k else np.zeros(len(context))
            self.mass[k], self.shared[k] = add(below), add((below > 0).astype(float))

    def _find(self, sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def _count(self, k: int, keys: np.ndarray) -> np.ndarray:
        at, found = self._find(self.grams[k], keys)
        return np.where(found, self.n[k][at], 0.0) if len(self.n[k]) else np.zeros(len(keys))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Of packed (context, symbol): the log10 chance of the symbol, with escapes and exclusion."""
        values, back = np.unique(grams, return_inverse=True)
        return self._log10(values)[back]

    def _log10(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        live = np.arange(len(grams))
        mass, shared, excluded = (np.zeros(len(grams)) for _ in range(3))
        for k in range(ORDER, -1, -1):
            part = grams[live] & _mask(k + 1)
            at, known = self._find(self.contexts[k], part >> _U(8))
            if not len(self.contexts[k]):
                continue
            total = np.where(known, self.total[k][at], 0) - mass[live]
            kinds = np.where(known, self.distinct[k][at], 0) - shared[live]
            some = known & (kinds > 0)
            times = np.where(some, self._count(k, part), 0)
            seen = times > 0
            bottom = np.where(some, total + kinds, 1)
            out[live] += np.log10(np.where(seen, times, np.where(some, kinds, 1)) / bottom)
            mass[live] = np.where(known, self.mass[k][at], 0)
            shared[live] = np.where(known, self.shared[k][at], 0)
            excluded[live] = np.where(known, self.distinct[k][at], excluded[live])
            live = live[~seen]
            if not len(live):
                return out
        out[live] -= np.log10(np.maximum(1, 256 - excluded[live]))
        return out


class Cache:
    """Chances by gram in a hash table with open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, chances: np.ndarray):
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, _U)
        self.values = np.zeros(1 << self.bits)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.slots[at] == _U(0xFFFFFFFFFFFFFFFF)
            self.slots[at[free]] = keys[left[free]]
            put = self.slots[at] == keys[left]
            self.values[at[put]] = chances[left[put]]
            left, at = left[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each gram, 0 where it is not held, and the indexes of those."""
        at = self._slot(grams)
        hit = self.slots[at] == grams
        out = np.where(hit, self.values[at], 0)
        miss = np.flatnonzero(~hit)
        absent = []
        at = at[miss]
        while len(miss):
            empty = self.slots[at] == _U(0xFFFFFFFFFFFFFFFF)
            absent.append(miss[empty])
            miss, at = miss[~empty], (at[~empty] + 1) & ((1 << self.bits) - 1)
            hit = self.slots[at] == grams[miss]
            out[miss[hit]] = self.values[at[hit]]
            miss, at = miss[~hit], at[~hit]
        return out, np.concatenate([np.zeros(0, np.int64), *absent])


def _mask(n_bytes: int) -> np.uint64:
    return _U((1 << (8 * n_bytes)) - 1)


def _chances(low):
    """Of whole parts of the trie: gram, n and chance of the grams that are asked for."""

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches if b.num_rows]
        if not held:
            return
        grams, n, asked = (np.concatenate(x) for x in zip(*held))
        grams, seen = grams.view(_U), n > 0
        counts = {k: _tally(grams[seen] & _mask(k + 1), n[seen]) for k in range(2, ORDER + 1)}
        grams, n = grams[asked], n[asked]
        found = Trie(counts | low.value).score(grams)
        for at in range(0, len(grams), HELD):
            part = slice(at, at + HELD)
            yield pa.RecordBatch.from_arrays([pa.array(grams[part].view(np.int64)), pa.array(n[part]), pa.array(found[part])], names=["gram", "n", "chance"])

    return chances


def _asked(grams: DataFrame, low, parts: int) -> DataFrame:
    """gram, n, chance of the rows of (gram, n, asked) that are asked for; n is 0 where no training text has the gram."""
    before = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    return grams.repartition(parts, before).mapInArrow(_chances(low), "gram long, n long, chance double")


def _scored(model, table):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = model.value, table.value
        key = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            rows = part.num_rows
            values, bounds = grams_of(part.column(2))
            chances, absent = cache.find(values)
            sums = np.add.reduceat(chances, bounds[:-1])
            # Grams outside the cache: distinct ones of each row and their number.
            owner, gram = np.searchsorted(bounds, absent, side="right") - 1, values[absent]
            by = np.lexsort((gram, owner))
            owner, gram = owner[by], gram[by]
            firsts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])])) if len(by) else by
            times = np.diff(np.append(firsts, len(by)))
            data, ends = buffers(part.column(2))
            raw = _FOLD[data].tobytes()
            base, n, n_known, rare = [], [], [], ([], [], [])
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                words = raw[a:b].split()
                logs = list(map(known.get, words))
                found = [x for x in logs if x is not None]
                n.append(len(words) + 1)
                n_known.append(len(found))
                base.append(sum(found))
                if len(found) < len(words):
                    some = Counter(w for w, x in zip(words, logs) if x is None)
                    rare[0].extend([key + i] * len(some))
                    rare[1].extend(some)
                    rare[2].extend(some.values())
            m, g = len(rare[0]), len(firsts)
            columns = [
                pa.array(np.repeat(np.arange(3, dtype=np.int32), [rows, m, g])),
                pa.array(np.concatenate([np.arange(key, key + rows), np.array(rare[0], np.int64), key + owner[firsts]])),
                pa.concat_arrays([part.column(0), pa.nulls(m + g, pa.int64())]),
                pa.concat_arrays([part.column(1), pa.nulls(m + g, pa.bool_())]),
                pa.array(np.concatenate([np.array(n + rare[2], np.int64), times])),
                pa.concat_arrays([pa.array(n_known, pa.int64()), pa.nulls(m + g, pa.int64())]),
                pa.concat_arrays([pa.array(base, pa.float64()), pa.nulls(m + g, pa.float64())]),
                pa.concat_arrays([pa.array(sums), pa.nulls(m + g, pa.float64())]),
                pa.concat_arrays([pa.nulls(rows, pa.binary()), pa.array(rare[1], pa.binary()), pa.nulls(g, pa.binary())]),
                pa.concat_arrays([pa.nulls(rows + m, pa.int64()), pa.array(gram[firsts].view(np.int64))]),
            ]
            key += rows
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "row_key", "doc_id", "held_out", "n", "n_known", "base", "score", "word", "gram"])

    return score


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counted = slim.where("not held_out").select("text").mapInArrow(_counted, "gram long, word binary, n long")
    counted = written(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")), "counts")
    words = counted.where("word is not null").select("word", "n")
    n_train = slim.where("not held_out").count()
    in_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = in_words + n_train, kinds + (n_train > 0)
    log = lambda c: np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))

    grams = counted.where("gram is not null").select("gram", "n")
    low = {1: grams.groupBy(F.col("gram").bitwiseAND(F.lit(int(_mask(2)))).alias("gram")).agg(F.sum("n").alias("n")).toArrow()}
    low = {1: (low[1].column("gram").to_numpy().view(_U), low[1].column("n").to_numpy())}
    low = context.broadcast({0: _tally(low[1][0] & _mask(1), low[1][1]), **low})
    parts = 1 + grams.count() // PART_GRAMS
    top = _asked(grams.withColumn("asked", F.lit(True)), low, parts).orderBy(F.desc("n"), "gram").limit(MODEL_GRAMS).toArrow()
    cache = Cache(top.column("gram").to_numpy().view(_U), top.column("chance").to_numpy())
    frequent = words.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).toArrow().to_pydict()
    table = {w: float(log(c)) for w, c in zip(frequent["word"], frequent["n"])}

    rows = written(slim.mapInArrow(_scored(context.broadcast(cache), context.broadcast(table)), "kind int, row_key long, doc_id long, held_out boolean, n long, n_known long, base double, score double, word binary, gram long"), "scored", "kind")
    bottom = F.lit(tokens + 0.1 * (kinds + 1))
    rare = rows.where("kind = 1").select("row_key", "word", F.col("n").alias("times")).join(words, "word", "left")
    rare = rare.groupBy("row_key").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / bottom)).alias("rare_base"))
    missed = rows.where("kind = 2").select("row_key", "gram", F.col("n").alias("times"))
    wanted = missed.groupBy("gram").agg(F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    chances = _asked(grams.withColumn("asked", F.lit(False)).union(wanted), low, parts).select("gram", "chance")
    missed = missed.join(chances, "gram").groupBy("row_key").agg(F.sum(F.col("times") * F.col("chance")).alias("rare_score"))
    end = float(log(n_train))
    return (
        rows.where("kind = 0")
        .join(rare, "row_key", "left")
        .join(missed, "row_key", "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n").alias("n_tokens"),
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_train > 0))).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end)).alias("base_score"),
            (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
        )
    )
