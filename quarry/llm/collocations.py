"""Phrase collocations: candidates counted by double-array tries.

1. Words of each language are counted by Spark. Tasks then hash all runs of 2, later of
   3 words whose parts may be frequent (Apriori: a phrase is no more frequent than its
   parts) and count the hashes; a hash below MIN_COUNT cannot hold a frequent phrase.
2. In one more pass a task cuts its texts into blocks. The different phrases of a block
   behind the other hashes become double-array tries over bytes, which hold phrases of all
   lengths. The task starts a state at every text position whose run may be a candidate,
   advances all states byte level by byte level, and counts accepting states.
3. Spark sums the blocks' counts by language and phrase. These counts are exact: hashes
   only choose what is walked.

Between steps, what may be frequent is told to tasks by filters of 64 bits for each of
it, 2 ** FILTER_BITS bits (32 MB) at most; when these fill up, more is walked, and
nothing is lost. A block has bounds of its own (PASS_SHARDS * SHARD_PHRASES phrases or
BLOCK_BYTES of text), so texts are read a fixed number of times, whatever the number of
candidates, and no task holds them all.

Defined results: null text is empty, null lang is `und`; repeated rows count each; an
empty table gives an empty result. Only `lang` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytes_np import U64, Words, buffers, mix, slices
from quarry.llm.scratch import release, small_batches, written

MIN_COUNT, LONGEST, TOP, COVERED = 10, 3, 2_000, 50
FILTER_BITS, SHARD_PHRASES, PASS_SHARDS = 28, 250_000, 4
#: Text of a block of counted phrases; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 24
#: Hashes that a task gathers before it counts and sends them.
BLOCK = 2_000_000
#: Parts that each language is split into for the first choice of its best phrases.
TOP_PARTS = 32
#: Rows up to which a table of words is broadcast (under 100 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 400_000
#: Bytes that no word holds: after a word inside its piece, after a piece's last word, after the language.
SPACE, END, TAB = 0x0A, 0x0D, 0x09
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[list(_BREAKS + b"\t")] = 0x20
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True


def _seed(name: bytes) -> int:
    return int.from_bytes(hashlib.sha256(name).digest()[:8], "little")


class Runs:
    """The words of a slice, and of every length the runs of words that no break cuts."""

    def __init__(self, langs: list[str | None], text: pa.Array):
        data, ends = buffers(text)
        self.words = w = Words(data, ends, _FOLD)
        n = len(w.start)
        names = [x if x is not None else "und" for x in langs]
        seeds = {x: _seed(x.encode()) for x in set(names)}
        self.names, self.seed = names, np.array([seeds[x] for x in names], U64)
        breaks = np.cumsum(_IS_BREAK[data], dtype=np.int32)[w.start] if n else np.zeros(0, np.int32)
        # Last word of each word's piece, so that a run of k words from i fits where i + k - 1 <= last[i].
        new = np.ones(n, bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (w.row[1:] != w.row[:-1])
        firsts = np.flatnonzero(new)
        self.last = np.repeat(np.append(firsts[1:], n) - 1, np.diff(np.append(firsts, n))) if n else np.zeros(0, np.int64)

    def starts(self, k: int) -> np.ndarray:
        return np.flatnonzero(np.arange(len(self.last)) + (k - 1) <= self.last)

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        w = self.words
        value = w.hash[at]
        for j in range(1, k):
            value = value * U64(0x9E3779B97F4A7C15) + w.hash[at + j]
        return mix(value ^ self.seed[w.row[at]] ^ U64(k))

    def allowed(self, k: int, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of k words that, by the filters of length k - 1 (and k if there is one), may be frequent."""
        at = self.starts(k)
        if k - 1 in filters:
            ok = np.zeros(len(self.last), bool)
            shorter = self.starts(k - 1)
            ok[shorter] = _maybe(filters[k - 1], self.hashes(k - 1, shorter))
            at = at[ok[at] & ok[at + 1]] if len(at) else at
        h = self.hashes(k, at)
        if k in filters:
            ok = _maybe(filters[k], h)
            at, h = at[ok], h[ok]
        return at, h

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes, each with SPACE or END behind it, and where each word begins."""
        w = self.words
        size = w.end - w.start
        begins = np.cumsum(size + 1) - (size + 1)
        out = np.full(int(begins[-1] + size[-1] + 1) if len(size) else 0, SPACE, np.uint8)
        if len(size):
            out[begins + size] = np.where(np.arange(len(size)) == self.last, END, SPACE)
            inside = np.flatnonzero(w.folded != 0x20)
            out[inside + np.repeat(begins - w.start, size)] = w.folded[inside]
        return out, begins


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for shift in (U64(0), U64(32)):
        slot = (h >> shift) & U64(len(bits) * 8 - 1)
        ok &= (bits[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1
    return ok


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    for part in slices(batches):
        yield Runs(part.column(0).to_pylist(), part.column(1))


def _bounds(k: int, filters):
    """Counts of hashes of runs of k words, summed over blocks of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = filters.value, [], 0

        def block():
            h, times = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(h), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(times[part])], names=["h", "n"])

        for runs in _runs(batches):
            held.append(runs.allowed(k, known)[1])
            n += len(held[-1])
            if n >= BLOCK:
                yield from block()
                held, n = [], 0
        if n:
            yield from block()

    return count


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i, whether a[at[i]:][:size[i]] equals b[bt[i]:][:size[i]]; sizes are positive."""
    if not len(size):
        return np.zeros(0, bool)
    firsts = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(firsts, size)
    return np.logical_and.reduceat(a[np.repeat(at, size) + within] == b[np.repeat(bt, size) + within], firsts)


class _Seen:
    """Phrases of a block: hashes in order, and their bytes."""

    def __init__(self):
        self.h, self.at, self.size, self.bytes = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def new(self, h: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places in h (sorted) of phrases that are not here yet; they are added. Equal hashes are compared by bytes."""
        if not len(h):
            return np.zeros(0, np.int64)
        place = np.searchsorted(self.h, h)
        hit = np.zeros(len(h), bool)
        if len(self.h):
            near = np.minimum(place, len(self.h) - 1)
            equal = np.flatnonzero((self.h[near] == h) & (self.size[near] == size))
            hit[equal[same_bytes(self.bytes, self.at[near[equal]], data, at[equal], size[equal])]] = True
        fresh = np.flatnonzero(~hit)
        if len(fresh):
            n = size[fresh]
            firsts = np.cumsum(n) - n
            body = data[np.repeat(at[fresh] - firsts, n) + np.arange(int(n.sum()))]
            self.at, self.size = np.insert(self.at, place[fresh], len(self.bytes) + firsts), np.insert(self.size, place[fresh], n)
            self.h, self.bytes = np.insert(self.h, place[fresh], h[fresh]), np.concatenate([self.bytes, body])
        return fresh


class Trie:
    """A double-array trie: the child of state s by byte b is base[s] + b if check there is s; END leads to a leaf with base -1 - number."""

    def __init__(self, base: np.ndarray, check: np.ndarray):
        self.base, self.check = base, check

    @classmethod
    def build(cls, keys: list[bytes], seed: int = 3) -> Trie:
        """Of distinct keys without END, in byte order; numbers are their places in that order."""
        size = np.array([len(k) + 1 for k in keys], np.int64)
        firsts = np.cumsum(size) - size
        data = np.frombuffer(b"".join(k + bytes([END]) for k in keys), np.uint8)
        base, check = np.zeros(1 << 12, np.int32), np.full(1 << 12, -1, np.int32)
        check[0] = np.iinfo(np.int32).max  # the root's own place is nobody's child
        used, rng = 1, np.random.default_rng(seed)

        def room(n: int) -> None:
            nonlocal base, check
            base, check = np.concatenate([base, np.zeros(n, np.int32)]), np.concatenate([check, np.full(n, -1, np.int32)])

        alive, state, depth = np.arange(len(keys)), np.zeros(len(keys), np.int64), 0
        while len(alive):
            byte = data[firsts[alive] + depth].astype(np.int64)
            new = np.ones(len(alive), bool)
            new[1:] = (state[1:] != state[:-1]) | (byte[1:] != byte[:-1])
            child = np.flatnonzero(new)  # one child for each state and byte
            parent, label = state[child], byte[child]
            heads = np.flatnonzero(np.diff(parent, prepend=-1))
            counts = np.diff(np.append(heads, len(child)))
            slot = np.zeros(len(child), np.int64)

            def put(some: np.ndarray, offer: np.ndarray) -> np.ndarray:
                """Put the children of some states at the offered places; those whose slots are free and not claimed twice stay there."""
                n = counts[some]
                begin = np.cumsum(n) - n
                member = np.repeat(heads[some] - begin, n) + np.arange(int(n.sum()))
                place = np.repeat(offer, n) + label[member]
                claimed, first = np.unique(place, return_index=True)
                mine = np.zeros(len(place), bool)
                mine[first] = check[claimed] < 0
                fits = np.logical_and.reduceat(mine, begin)
                good = np.repeat(fits, n)
                check[place[good]] = parent[member[good]]
                base[parent[heads[some[fits]]]] = offer[fits]
                slot[member[good]] = place[good]
                return some[~fits]

            # At most two thirds of the slots are taken, so that a random place soon fits; wide states that find none get room of their own.
            used += len(child)
            if used * 3 // 2 + 512 > len(check):
                room(used * 3 // 2 + 512 - len(check))
            waiting, tries = np.argsort(-counts, kind="stable"), 0
            while len(waiting):
                tries += 1
                waiting = put(waiting, rng.integers(0, len(check) - 256, len(waiting)))
                if tries % 8 == 0 and len(waiting):
                    n, at = max(16, len(waiting) // 8), len(check)
                    wide, waiting = waiting[:n], waiting[n:]
                    room(256 * len(wide))
                    put(wide, at + 256 * np.arange(len(wide)))
            state = slot[np.cumsum(new) - 1]
            done = byte == END
            base[state[done]] = -1 - alive[done]
            alive, state = alive[~done], state[~done]
            depth += 1
        room(256)
        return cls(base, check)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which of them exist."""
        to = self.base[state] + byte
        return to, self.check[to] == state

    def walk(self, key: bytes) -> int:
        """The state behind a key, or -1."""
        state = 0
        for b in key:
            to = int(self.base[state]) + b
            if self.check[to] != state:
                return -1
            state = to
        return state

    def accepted(self, state: np.ndarray, data: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Numbers of the keys of 2 words to ``most`` met by states that start at places of data, once for each place."""
        out = [np.zeros(0, np.int64)]
        alive = state >= 0
        state, at, most = state[alive], at[alive], most[alive]
        read = np.zeros(len(state), np.int8)
        while len(state):
            byte = data[at]
            closing = (byte == SPACE) | (byte == END)
            read = read + closing
            leaf, ok = self.step(state[closing & (read > 1)], END)
            out.append(-1 - self.base[leaf[ok]].astype(np.int64))
            go = ~closing | (read < most)
            state, at, most, read = state[go], at[go], most[go], read[go]
            to, ok = self.step(state, byte[go])
            state, at, most, read = to[ok], at[ok] + 1, most[ok], read[ok]
        return np.concatenate(out)


class _Block:
    """Texts of a task: the different phrases that may be frequent, and the places where their runs begin."""

    def __init__(self):
        self.seen, self.langs = _Seen(), {}
        self.keys, self.of, self.k, self.head, self.places, self.size = [], [], [], [], [], 0

    def add(self, part: pa.RecordBatch, known: dict[int, np.ndarray]) -> None:
        runs = Runs(part.column(0).to_pylist(), part.column(1))
        data, begins = runs.joined()
        ends = np.append(begins[1:], len(data)) - 1
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in runs.names], np.int64)
        # How many words the longest run from each word has that, with all shorter ones, may be frequent.
        most, head = np.ones(len(runs.last), np.int8), np.zeros(len(runs.last), U64)
        for k in range(2, LONGEST + 1):
            at, h = runs.allowed(k, known)
            ok = most[at] == k - 1
            at, h = at[ok], h[ok]
            most[at] = k
            if k == 2:
                head[at] = h
            self._phrases(runs, lang, data, begins, ends, head, k, at, h)
        at = np.flatnonzero(most > 1)
        self.places.append((data, begins[at].astype(np.int32), most[at], lang[runs.words.row[at]].astype(np.int32), head[at]))
        self.size += len(data)

    def _phrases(self, runs: Runs, lang, data, begins, ends, head, k: int, at: np.ndarray, h: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        first, size = begins[at], ends[at + k - 1] - begins[at] if len(at) else at
        repeat = np.zeros(len(at), bool)
        equal = np.flatnonzero((h[1:] == h[:-1]) & (size[1:] == size[:-1])) + 1
        repeat[equal[same_bytes(data, first[equal], data, first[equal - 1], size[equal])]] = True
        kept = np.flatnonzero(~repeat)
        at, h, first, size = at[kept], h[kept], first[kept], size[kept]
        fresh = self.seen.new(h, data, first, size)
        body = data.tobytes()
        self.keys += [body[a : a + n] for a, n in zip(first[fresh].tolist(), size[fresh].tolist())]
        self.of.append(lang[runs.words.row[at[fresh]]])
        self.k.append(np.full(len(fresh), k, np.int32))
        self.head.append(head[at[fresh]])

    def counts(self) -> Iterator[pa.RecordBatch]:
        """Counts of accepting states. A phrase and its first two words are in the same trie, one of as many as SHARD_PHRASES asks for."""
        of, lengths, head, names = np.concatenate(self.of), np.concatenate(self.k), np.concatenate(self.head), list(self.langs)
        shards = U64(max(1, -(-len(self.keys) // SHARD_PHRASES)))
        trie_of, places = head % shards, [(*p[:4], p[4] % shards) for p in self.places]
        roots = [b"%d\t" % x for x in range(len(names))]
        whole = pa.array([roots[x] + key for key, x in zip(self.keys, of.tolist())], pa.binary())
        spelt = pc.replace_substring(pa.array(self.keys, pa.binary()).cast(pa.string()), "\n", " ")
        for shard in range(int(shards)):
            mine = np.flatnonzero(trie_of == shard)
            if not len(mine):
                continue
            mine = mine[pc.array_sort_indices(whole.take(pa.array(mine))).to_numpy()]
            trie, total = Trie.build(whole.take(pa.array(mine)).to_pylist()), np.zeros(len(mine), np.int64)
            starts = np.array([trie.walk(x) for x in roots], np.int64)
            for data, begins, most, lang, to in places:
                here = to == shard
                total += np.bincount(trie.accepted(starts[lang[here]], data, begins[here], most[here]), minlength=len(total))
            for a in range(0, len(mine), 100_000):
                some = mine[a : a + 100_000]
                langs = pa.DictionaryArray.from_arrays(pa.array(of[some], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, pa.array(lengths[some]), spelt.take(pa.array(some)), pa.array(total[a : a + 100_000])], names=["lang", "k", "phrase", "a"])


def _counted(filters):
    """Occurrences of the phrases of a task that may be frequent, by blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = filters.value, _Block()
        for part in slices(batches):
            block.add(part, known)
            if len(block.keys) >= PASS_SHARDS * SHARD_PHRASES or block.size >= BLOCK_BYTES:
                yield from block.counts()
                block = _Block()
        if block.keys:
            yield from block.counts()

    return count


def _filter(hashes: DataFrame) -> np.ndarray:
    """A filter of the column h of a written table, put together from pieces of 4 KB."""
    bits_of = min(FILTER_BITS, max(15, (64 * hashes.count()).bit_length()))
    mask = (1 << bits_of) - 1
    slots = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("s")).select(F.col("s") + 1)
    slot = F.col(slots.columns[0])  # Spark's buckets begin with 1
    pieces = slots.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    bits = np.zeros(1 << (bits_of - 3), np.uint8)
    for b, piece in zip(pieces.column("b").to_pylist(), pieces.column("bits")):
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(piece.as_buffer(), np.uint8)
    return bits


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for runs in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(runs.hashes(1, np.arange(len(runs.last))).view(np.int64))], names=["h"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, a): occurrences of each word; case is folded once for each spelling."""
    spelt = docs.select("lang", F.explode(F.split("text", r"[\x20\x09.,;:!?\x0A-\x0D]+")).alias("w")).where("w != ''").groupBy("lang", "w").agg(F.count("*").alias("a"))
    return spelt.groupBy(F.coalesce("lang", F.lit("und")).alias("lang"), F.translate("w", _UPPER, _LOWER).alias("phrase")).agg(F.sum("a").alias("a"))


def phrase_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, k, phrase, a): phrases of 2 to LONGEST words with MIN_COUNT occurrences or more; words: word_counts from MIN_COUNT on."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    filters = {1: _filter(written(words.select("lang", F.col("phrase").alias("text")).mapInArrow(_word_hashes, "h long"), "hashes"))}
    for k in range(2, LONGEST + 1):
        release(spark)
        known = share(filters)
        sums = docs.mapInArrow(_bounds(k, known), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {MIN_COUNT}")
        filters = filters | {k: _filter(written(sums.select("h"), "hashes"))}
        known.unpersist()
    release(spark)
    known = share({k: v for k, v in filters.items() if k > 1})
    return docs.mapInArrow(_counted(known), "lang string, k int, phrase string, a long").groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a")).where(f"a >= {MIN_COUNT}")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    from pyspark.sql import Window

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    every = written(word_counts(docs).withColumn("frequent", F.col("a") >= MIN_COUNT), "words", "frequent")
    totals = every.groupBy("lang").agg(F.sum("a").alias("n"))
    words = every.where("frequent").select("lang", "phrase", "a")
    phrases = written(phrase_counts(docs, words), "phrases", "k")

    parts = words.unionByName(phrases.where(f"k < {LONGEST}").select("lang", "phrase", "a"))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    word = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")
    cuts = phrases.withColumn("w", word).select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "w").select("lang", "phrase", "k", "a", "cut", piece(F.lit(1), F.col("cut")).alias("head"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "k", "a", "x.score", "x.l", "x.r")

    longer = phrases.where("k > 2").withColumn("w", word).select("lang", "a", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " ")))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {COVERED} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task sorts all its phrases.
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
