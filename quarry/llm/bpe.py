"""Byte-level BPE: ranked merges folded over byte arrays by Spark's higher-order functions.

``fold`` is a column expression: it turns an array of bytes into token ids by
merging, again and again, the adjacent pair of lowest rank (leftmost on ties).
Pair ranks are one array, a cuckoo hash map in which a pair has two places, so a
lookup costs two reads however large the vocabulary. It holds the one pair of each
token that can ever make it. The array is written once and reaches the plan as a
scalar subquery: as a literal it stood in every listing of the plan that the driver keeps.

1. Tasks cut texts into words by the split pattern and count their distinct
   words; one shuffle adds the counts of the whole corpus.
2. The TABLE_WORDS most frequent distinct words are folded once, and their ids
   are packed in executors into a table that is broadcast: at most
   TABLE_WORDS * (10 + 4 * TABLE_BYTES) bytes, typically 15 bytes a word.
3. Tasks cut texts again and take ids from the table. Every word that the table
   lacks is folded by the same expression in its own row, once a row. Nothing is
   assumed about other rows or batches, and no text is shuffled. What was looked
   up is decoded and held against the text, so a hash collision cannot pass.

A word of over CUT bytes is cut where two bytes meet that stand side by side in
no token: no merge can cross such a place, so the ids are the same. What still
has over FOLD_BYTES bytes without such a place (one letter repeated thousands of
times) is merged with a heap, because the fold costs the square of its length.

Defined results: null and empty texts have no tokens; special-token strings are
ordinary text; very long texts are cut like others; repeated rows are encoded one
by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.bytes_np import _BYTE, buffers, mix, powers, slices
from quarry.llm.scratch import small_batches, written

#: Words of the broadcast table at most, and their bytes at most.
TABLE_WORDS, TABLE_BYTES = 1_000_000, 24
#: Distinct words a task counts before it passes them on.
HELD = 150_000
CUT, FOLD_BYTES = 48, 2_048
PLAN_CHARS = 50_000
#: Bytes of text that a task cuts into words at once.
SLICE = 1 << 18
_BITS, _NONE = 17, 99_999
#: Multipliers below 2**30, so that products of 32-bit pairs stay within a long.
_MIXERS = (0x2545F491, 0x1B873593)
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)

#: Fixed value: the split pattern that `_starts` implements on bytes; other patterns go through the regex library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a ``base64 rank`` file; read by Spark where the path is a URI, else from the driver's disk."""
    lines = [r[0] for r in spark.read.text(path).collect()] if "://" in path else open(path).read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _places(pair: int) -> list[int]:
    return [((pair * m) >> 22) & ((1 << _BITS) - 1) for m in _MIXERS]


def last_merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The pair whose merge completes a token when its bytes are merged by themselves; None if they never do.

    Within any text, the merges inside the bytes that become one token are those of these
    bytes by themselves, so no other pair ever makes that token.
    """
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        known = [ranks.get(x + y, _NONE) for x, y in zip(parts, parts[1:])]
        best = min(known)
        if best == _NONE:
            return None
        if len(parts) == 2:
            return ranks[parts[0]], ranks[parts[1]]
        at = known.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return None


def pair_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Cuckoo table of the one pair that makes each token: pair << 16 | rank, -1 where empty."""
    table = np.full(1 << _BITS, -1, np.int64)
    for word, rank in ranks.items():
        pair = last_merge(word, ranks)
        if pair is None:
            continue
        entry, place = ((pair[0] << 16 | pair[1]) << 16) | rank, None
        for _ in range(500):
            first, second = _places(entry >> 16)
            place = first if place is None or place == second else second
            entry, table[place] = int(table[place]), entry
            if entry < 0:
                break
        else:
            raise ValueError("the pair table is too full")
    return table


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(spark: SparkSession, ranks: dict[bytes, int]):
    """A function that replaces the column ``words`` of a frame, array<array<int>> words of bytes, by their array<array<int>> token ids."""
    both = [ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)]
    row = {"pairs": pa.array([pair_table(ranks)], pa.list_(pa.int64())), "two": pa.array([both], pa.list_(pa.int32()))}
    tables = written(spark.createDataFrame(pa.table(row)), "ranks")
    singles = F.split(F.lit(",".join(str(ranks[bytes([b])]) for b in range(256))), ",").cast("array<int>")  # folded to one literal by the optimizer
    none = F.lit(_NONE)

    def rank(pairs: Column, a: Column, b: Column) -> Column:
        def probe(pair: Column) -> Column:
            at = [F.get(pairs, F.shiftright(pair * F.lit(m), 22).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")) for m in _MIXERS]
            hit = [F.shiftright(x, 16) == pair for x in at]
            low = [x.bitwiseAND(F.lit(65535)).cast("int") for x in at]
            return F.when(hit[0], low[0]).when(hit[1], low[1]).otherwise(none)

        return _let(a.cast("bigint") * F.lit(65536) + b, probe)

    def merge(pairs: Column, state: Column) -> Column:
        ids, known = state["ids"], state["ranks"]

        def at(best: Column, p: Column) -> Column:
            left = F.when(p > 1, F.array(rank(pairs, F.get(ids, p - 2), best))).otherwise(F.array().cast("array<int>"))
            right = F.when(p + 1 < F.size(ids), F.array(rank(pairs, best, F.get(ids, p + 1)))).otherwise(F.array().cast("array<int>"))
            size = F.size(ids)
            merged = F.concat(F.slice(ids, F.lit(1), p - 1), F.array(best), F.slice(ids, p + 2, size))
            ranked = F.concat(F.slice(known, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(known, p + 2, size))
            return F.struct(merged.alias("ids"), ranked.alias("ranks"))

        return _let(F.array_min(known), lambda best: F.when(best.isNull() | (best == none), state).otherwise(_let(F.array_position(known, best).cast("int"), lambda p: at(best, p))))

    def one(pairs: Column, bytes_two: Column, word: Column) -> Column:
        ids = F.transform(word, lambda b: F.get(singles, b))
        ranked = F.zip_with(F.slice(word, F.lit(1), F.greatest(F.size(word) - 1, F.lit(0))), F.slice(word, F.lit(2), F.size(word)), lambda a, b: F.get(bytes_two, a * 256 + b))
        first = F.struct(ids.alias("ids"), ranked.alias("ranks"))
        return F.aggregate(F.slice(word, F.lit(2), F.size(word)), first, lambda state, _: merge(pairs, state), lambda state: state["ids"])

    def folded(rows: DataFrame) -> DataFrame:
        # The tables are bound once, outside all lambdas; each is used once, so the optimizer puts the subqueries in place and no row carries a table.
        bound = rows.select("*", *(tables.select(c).scalar().alias(c) for c in row))
        words = _let(F.col("pairs"), lambda pairs: _let(F.col("two"), lambda bytes_two: F.transform("words", lambda word: one(pairs, bytes_two, word))))
        return bound.select(*(words.alias(c) if c == "words" else c for c in rows.columns))

    return folded


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word in n log n steps."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, to = heapq.heappop(queue)
        if end[i] == 0 or after[i] >= n or end[after[i]] != to:
            continue
        j = after[i]
        end[i], end[j], after[i] = to, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(queue, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:to])) is not None:
            heapq.heappush(queue, (r, h, to))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


@functools.lru_cache(1)
def _code_point_classes() -> np.ndarray:
    """Letter, number, white space or other of every code point."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    # Surrogates are no characters.
    for first, beyond in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, beyond)))
        for name, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _SPACE)):
            for m in regex.finditer(name, every):
                out[first + m.start() : first + m.end()] = kind
    return out


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _code_point_classes()
    out = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) for k in range(4)]
    low = [x & 63 for x in b]
    two, three = (b[0] & 31) << 6 | low[1], (b[0] & 15) << 12 | low[1] << 6 | low[2]
    four = np.minimum((b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3], 0x10FFFF)
    size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    kind = table[np.where(size == 2, two, np.where(size == 3, three, four))]
    for k in range(4):
        some = (size > k) & (lead + k < len(data))
        out[lead[some] + k] = kind[some]
    return out


def _starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First bytes of the matches of PATTERN, which cover every text without gaps."""
    n = len(data)
    kind = _classes(data)
    row = np.zeros(n + 3, bool)
    row[ends] = True
    new = row.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(new[:n])
    # White space before a text of its row: all but the last character is a match; a last blank joins what follows.
    spaces = np.flatnonzero((kind[runs[:-1]] == _SPACE) & ~row[runs[1:]])
    beyond = runs[spaces + 1]
    last = beyond - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    new[last] = True
    new[beyond[data[last] == 0x20]] = False
    # Contractions, where an apostrophe begins a match.
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    mark = np.flatnonzero(data == 0x27)
    mark = mark[new[mark] & ~row[mark + 1]]
    one, both = padded[mark + 1], padded[mark + 1].astype(np.int32) << 8 | padded[mark + 2]
    short = mark[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    pair = mark[np.isin(both, [a << 8 | b for a, b in (b"re", b"ve", b"ll")]) & ~row[mark + 2]]
    for at, size in ((short, 2), (pair, 3)):
        new[at + 1] = False
        new[at + size] = True
    return np.flatnonzero(new[:n])


def _starts_by_regex(pattern: str, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of matches and of gaps between them, and which are matches."""
    import regex

    find, raw = regex.compile(pattern).finditer, data.tobytes()
    starts, match = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        text, seen, at = raw[a:b].decode("utf-8", "replace"), 0, a
        for m in find(text):
            if not m[0]:
                continue
            if m.start() > seen:
                starts.append(at)
                match.append(False)
                at += len(text[seen : m.start()].encode())
            starts.append(at)
            match.append(True)
            at += len(m[0].encode())
            seen = m.end()
        if at < b:
            starts.append(at)
            match.append(False)
    return np.array(starts, np.int64), np.array(match, bool)


def neighbours(ranks: dict[bytes, int]) -> np.ndarray:
    """For each two bytes: whether they stand side by side in any token."""
    out = np.zeros(65536, bool)
    for word in ranks:
        w = np.frombuffer(word, np.uint8).astype(np.int32)
        out[w[:-1] << 8 | w[1:]] = True
    return out


class Cut:
    """The words of a slice: first byte, end, row bounds in them, hash; long words are cut where no token can cross."""

    def __init__(self, pattern: str, beside: np.ndarray, data: np.ndarray, ends: np.ndarray):
        if not len(data):
            starts, match = np.zeros(0, np.int64), None
        elif pattern == PATTERN:
            starts, match = _starts(data, ends), None
        else:
            starts, match = _starts_by_regex(pattern, data, ends)
        sizes = np.diff(np.append(starts, len(data)))
        extra = [i + 1 + np.flatnonzero(~beside[data[i : i + n - 1].astype(np.int32) << 8 | data[i + 1 : i + n]]) for i, n in zip(starts[sizes > CUT].tolist(), sizes[sizes > CUT].tolist())]
        if extra:
            more = np.concatenate(extra)
            at = np.searchsorted(starts, more)
            match = None if match is None else np.insert(match, at, match[at - 1])
            starts = np.insert(starts, at, more)
            sizes = np.diff(np.append(starts, len(data)))
        value = np.zeros(0, _U)
        if len(starts):
            value = _BYTE[data] * powers(int(sizes.max()))[np.arange(len(data)) - np.repeat(starts, sizes)]
            value = mix(np.add.reduceat(value, starts))
        if match is not None:
            starts, sizes, value = starts[match], sizes[match], value[match]
        self.start, self.size, self.hash, self.bounds = starts, sizes, value, np.searchsorted(starts, ends)


def _counted(pattern: str, beside):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of a task and their number."""
        words: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for part in slices(batches, most=SLICE):
            data, ends = buffers(part.column(0))
            cut = Cut(pattern, beside.value, data, ends)
            some = np.flatnonzero(cut.size <= TABLE_BYTES)
            _, first, times = np.unique(cut.hash[some], return_index=True, return_counts=True)
            first, raw = some[first], data.tobytes()
            for a, size, k in zip(cut.start[first].tolist(), cut.size[first].tolist(), times.tolist()):
                words[raw[a : a + size]] += k
            if len(words) > HELD:
                yield flushed()
                words.clear()
        yield flushed()

    return count


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([batch.column(0).to_pylist()], 1)], names=["word", "bytes"])


def _lists(rows: list[list[bytes]], depth: int = 2) -> pa.Array:
    """Words as lists of their bytes: one flat list of words (depth 1) or a list of words a row (depth 2)."""
    flat = [w for r in rows for w in r]
    bounds = np.cumsum([0] + [len(w) for w in flat])
    words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.uint8).astype(np.int32)))
    return words if depth == 1 else pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32()), words)


def _packed(kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of folded words (word, ids): one row of packed hashes, numbers of ids, and ids."""
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            data, ends = buffers(batch.column(0).cast(pa.binary()))
            value = _BYTE[data] * powers(TABLE_BYTES)[np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))]
            hashes = mix(np.add.reduceat(value, ends[:-1]))
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.uint8)
            columns = [hashes.tobytes(), sizes.tobytes(), lists.flatten().to_numpy().astype(kind).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["hashes", "sizes", "ids"])

    return pack


class Pieces:
    """The bytes of every token."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            pieces[rank] = word
        self.kind = "<u2" if len(pieces) <= 65536 else "<u4"
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        return self.pool[_taken(self.first[ids], self.size[ids])]


class Vocabulary:
    """Ids of frequent words by hash: an open-addressing table that a task makes of the packed blocks and drops at its end."""

    def __init__(self, blocks: list[tuple[bytes, bytes, bytes]], kind: str):
        hashes, sizes, self.ids = (np.concatenate([np.zeros(0, t), *(np.frombuffer(b[k], t) for b in blocks)]) for k, t in enumerate((_U, np.uint8, kind)))
        self.kind, self.size = kind, sizes
        self.first = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32)
        self.places = max(64, len(hashes) * 3 // 2)
        self.slots, self.entry = np.full(self.places, _EMPTY, _U), np.zeros(self.places, np.int32)
        for start in range(0, len(hashes), 200_000):
            left = np.arange(start, min(start + 200_000, len(hashes)))
            at = self._slot(hashes[left])
            while len(left):
                free = self.slots[at] == _EMPTY
                self.slots[at[free]] = hashes[left[free]]
                # Of several that write to one slot the last stays, and of equal hashes the entry of the last.
                mine = self.slots[at] == hashes[left]
                self.entry[at[mine & free]] = left[mine & free]
                left, at = left[~mine], (at[~mine] + 1) % self.places

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes >> _U(32)) * _U(self.places)) >> _U(32)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            held = self.slots[at]
            hit = held == hashes[left]
            out[left[hit]] = self.entry[at[hit]]
            on = ~hit & (held != _EMPTY)
            left, at = left[on], (at[on] + 1) % self.places
        return out


def _taken(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs that begin at first and have the given sizes."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _split(pattern: str, kind: str, blocks, ranks, beside):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = Vocabulary(blocks.value, kind), Pieces(ranks.value)
        for part in slices(batches, most=SLICE):
            data, ends = buffers(part.column(1))
            words = Cut(pattern, beside.value, data, ends)
            raw = data.tobytes()
            of = lambda i, w=words, r=raw: r[w.start[i] : w.start[i] + w.size[i]]
            entry, ids_of = known.find(words.hash), known.ids
            # Look-ups are held against the text; a word that does not decode to itself is unknown.
            hit = np.flatnonzero(entry >= 0)
            ids = ids_of[_taken(known.first[entry[hit]].astype(np.int64), known.size[entry[hit]].astype(np.int64))]
            spelt = data[_taken(words.start[hit], words.size[hit])]
            if not np.array_equal(pieces.decode(ids), spelt):
                false = [i for i in hit.tolist() if pieces.decode(ids_of[known.first[entry[i]] : known.first[entry[i]] + known.size[entry[i]]]).tobytes() != of(i)]
                entry[false] = -1
            sizes, firsts = np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
            hit = np.flatnonzero(entry >= 0)
            sizes[hit], firsts[hit] = known.size[entry[hit]], known.first[entry[hit]]
            absent = np.flatnonzero(entry < 0)
            huge = absent[words.size[absent] > FOLD_BYTES]
            for i in huge.tolist():
                merged = np.array(heap_merge(of(i), ranks.value), known.kind)
                firsts[i], sizes[i] = len(ids_of), len(merged)
                ids_of = np.concatenate([ids_of, merged])
            absent = absent[words.size[absent] <= FOLD_BYTES]
            taken = ids_of[_taken(firsts, sizes)]
            before = np.concatenate([[0], np.cumsum(sizes)])
            row_of = np.searchsorted(words.bounds, absent, side="right") - 1
            where = before[absent] - before[words.bounds[row_of]]
            rare: list[list[bytes]] = [[] for _ in range(part.num_rows)]
            places: list[list[int]] = [[] for _ in range(part.num_rows)]
            numbers: dict[bytes, int] = {}
            held = -1
            for r, i in zip(row_of.tolist(), absent.tolist()):
                if r != held:
                    held, numbers = r, {}
                number = numbers.setdefault(word := of(i), len(numbers))
                if number == len(rare[r]):
                    rare[r].append(word)
                places[r].append(number)
            rows = before[words.bounds]
            wide = taken.itemsize
            packed, all_ids = [], taken.tobytes()
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                packed.append(all_ids[a * wide : b * wide])
            per_row = pa.array(np.searchsorted(row_of, np.arange(part.num_rows + 1)), pa.int32())
            gaps = pa.ListArray.from_arrays(per_row, pa.array(where, pa.int32()))
            numbered = pa.ListArray.from_arrays(per_row, pa.array([p for r in places for p in r], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), gaps, numbered, _lists(rare)], names=["doc_id", "known", "gaps", "places", "words"])

    return cut


def _join(ranks):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                encoded, decoded = [], []
                for packed, gaps, places, folded in zip(part.column(1), *part.columns[2:]):
                    ids = np.frombuffer(packed.as_buffer(), pieces.kind).astype("<u4")
                    if gaps.values is not None and len(gaps.values):
                        lists = folded.values
                        flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                        at = places.values.to_numpy()
                        sizes = (cuts[1:] - cuts[:-1])[at].astype(np.int64)
                        ids = np.insert(ids, np.repeat(gaps.values.to_numpy(), sizes), flat[_taken(cuts[at].astype(np.int64), sizes)])
                    encoded.append(ids.tobytes())
                    decoded.append(pieces.decode(ids).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return assemble


def _frequent(counted: DataFrame) -> DataFrame:
    """Words of a number of occurrences at which no more than TABLE_WORDS remain."""
    sizes = sorted(((r["n"], r["words"]) for r in counted.groupBy(F.floor(F.log2("n") * 16).alias("n")).agg(F.count("*").alias("words")).collect()), reverse=True)
    within, least = 0, None
    for n, words in sizes:
        if (within := within + words) > TABLE_WORDS:
            break
        least = n
    return counted.where(F.floor(F.log2("n") * 16) >= least) if least is not None else counted.limit(0)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit integers), decoded (their bytes)."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    # The driver keeps listings of every plan.
    docs.sparkSession.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    folded, beside, shared, kind = fold(docs.sparkSession, ranks), context.broadcast(neighbours(ranks)), context.broadcast(ranks), Pieces(ranks).kind
    counted = slim.select("text").mapInArrow(_counted(pattern, beside), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = _frequent(written(counted, "words")).select("word").repartition(48)
    rows = words.mapInArrow(_as_bytes, "word binary, bytes array<int>").select("word", F.array("bytes").alias("words"))
    rows = folded(rows).select("word", F.get("words", F.lit(0)).alias("ids"))
    blocks = written(rows.mapInArrow(_packed(kind), "hashes binary, sizes binary, ids binary"), "table").toArrow()
    blocks = list(zip(*(blocks.column(k).to_pylist() for k in range(3))))
    packed = context.broadcast(blocks)
    del blocks
    pa.default_memory_pool().release_unused()
    cut = slim.mapInArrow(_split(pattern, kind, packed, shared, beside), "doc_id long, known binary, gaps array<int>, places array<int>, words array<array<int>>")
    return folded(cut).mapInArrow(_join(shared), "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_and_decode's rows."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
