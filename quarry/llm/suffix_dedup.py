"""Removal of long repeated byte strings with two-stage suffix sorting.

A byte goes if it lies in a LENGTH-byte string that also starts elsewhere, in
any document. The search runs in three steps:

1. Anchors. Every LENGTH-byte window owns the least hash of its GRAM-byte grams
   (rightmost on ties), so equal windows own equal grams at equal offsets. The
   windows of one gram form a segment. Segments are counted by gram and content,
   with map-side aggregation, so copies of any number shrink to one row.
2. Suffix sorting. Of grams whose segments differ, one text of each distinct
   segment is shipped to the gram's task. There the suffixes that are smaller
   than their successors are sorted directly, the others are induced by
   scanning buckets in order, and adjacent common prefixes of LENGTH bytes or
   more mark the windows that occur at two places. A gram with more segments
   than one task's bound goes to an exchange of packed window hashes instead,
   which is dealt by hash and so has no hot task.
3. Removal. What is known of a segment goes back to all documents that hold it,
   and tasks cut the spans from the texts.

Passages of SHARED words that also stand in another document are often shorter
than LENGTH bytes. They are not removed but counted on request, by the same
anchors over words: segments that own one gram compare the hashes of their windows.
A row ships segments only of grams that other rows hold, and equal ones once.

Defined results: null and empty texts have no bytes; texts below LENGTH bytes
keep all; rows that repeat a text are different documents and so repeat each
other; a null or repeated doc_id is told apart by its text. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytes_np import WHITE, _BASE, _BYTE, buffers, mix, slices
from quarry.llm.jaccard_join import _runs_of
from quarry.llm.scratch import small_batches, written

LENGTH, GRAM = 400, 32
#: Words of a shared passage, and of its grams; words lie between white space.
SHARED, SHARED_GRAM = 50, 12
#: Segments of one gram, and bytes of segments, that a task sorts together.
RUN_SEGMENTS, SORT_BYTES = 2_000, 1_500_000
#: Bytes of spans up to which they are broadcast to the documents; more are joined by a shuffle.
BROADCAST_BYTES = 1 << 28
#: Bits of the filter of shipped segments at most (32 MB); a fuller filter ships more rows, no fewer.
FILTER_BITS = 28
_U = np.uint64
_INSIDE = ~np.isin(np.arange(256), list(WHITE))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def _least_of(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` neighbours."""
    step = 1
    while step * 2 <= reach:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (reach - step)], values[reach - step :])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, and gram hash of every segment of a slice."""
    n, reach = len(data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(_U)
    gram, step, base = _BYTE[data], 1, _BASE
    while step < GRAM:
        gram = gram[:-step] * base + gram[step:]
        with np.errstate(over="ignore"):
            base = base * base
        step *= 2
    gram = mix(gram)
    least = (gram & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(gram), dtype=_U))
    least = _least_of(least, reach)
    anchor = (_U(0xFFFFFFFF) - (least & _U(0xFFFFFFFF))).astype(np.int64)
    sizes = np.diff(ends)
    rows = np.flatnonzero(sizes >= LENGTH)
    counts = sizes[rows] - LENGTH + 1
    row = np.repeat(rows, counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + ends[row]
    if not len(row):
        return none, none, none, none.view(_U)
    anchor = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], start[last], gram[anchor[first]]


def _segment_rows(part: pa.RecordBatch):
    """Of a slice (doc_id, text): its bytes, and row, text hash, first, last, gram, content hash and place of each segment."""
    import xxhash

    data, ends = buffers(part.column(1))
    row, first, last, gram = segments(data, ends)
    raw = memoryview(np.ascontiguousarray(data))
    tids = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], _U)
    content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())), _U, len(first))
    place = mix(tids[row]) + (first - ends[row]).astype(_U)
    return raw, ends, row, tids, first, last, gram, content, place


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        _, ends, row, tids, first, last, gram, content, place = _segment_rows(part)
        columns = [part.column(0).take(pa.array(row)), *(pa.array(x.view(np.int64)) for x in (tids[row], gram, content, place, first - ends[row], last - first + 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "gram", "content", "place", "at", "owned"])


def _shipped(packed, bits: int):
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = packed.value
        for part in slices(batches):
            raw, _, _, _, first, last, gram, content, place = _segment_rows(part)
            at = (mix(place) >> _U(64 - bits)).astype(np.int64)
            some = np.flatnonzero((filtered[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            texts = [raw[a : b + LENGTH] for a, b in zip(first[some].tolist(), last[some].tolist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[some].view(np.int64)) for x in (gram, content, place, last - first + 1)), pa.array([bytes(t) for t in texts], pa.binary())], names=["gram", "content", "place", "owned", "text"])

    return ship


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions where ``wanted`` is set, in the order of their suffixes' first ``depth`` bytes at least."""
    n = len(text)
    change = np.zeros(n, np.int8)
    change[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    change[-1] = -1
    # An equal successor takes the type of the next change.
    nearest = np.where(change != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    small = change[nearest] > 0
    # Induction walks from a small suffix leftwards, so each wanted run extends to the next small one.
    beyond = np.where(small, np.arange(n), n - 1)
    beyond = np.minimum.accumulate(beyond[::-1])[::-1]
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(edge, at, 1)
    np.add.at(edge, beyond[at] + 1, -1)
    inside = np.cumsum(edge[:n]) > 0
    raw = text.tobytes()
    direct = np.flatnonzero(inside & small).tolist()
    direct.sort(key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)
    leads = text[direct]
    bounds = np.searchsorted(leads, np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if inside[n - 1] and not small[n - 1]:
        queues[text[n - 1]].append(np.array([n - 1]))
    order = []

    def induce(batch: np.ndarray, lead: int) -> np.ndarray:
        """Queue the larger predecessors of a batch; return those that belong to the same bucket."""
        before = batch[batch > 0] - 1
        before = before[inside[before] & ~small[before]]
        letters = text[before]
        own = before[letters == lead]
        rest, letters = before[letters != lead], letters[letters != lead]
        by = np.argsort(letters, kind="stable")
        rest, letters = rest[by], letters[by]
        cuts = np.flatnonzero(np.diff(letters)) + 1
        for group in np.split(rest, cuts) if len(rest) else ():
            queues[text[group[0]]].append(group)
        return own

    for lead in range(256):
        batch = np.concatenate(queues[lead]) if queues[lead] else np.zeros(0, np.int64)
        queues[lead] = []
        while len(batch):
            order.append(batch)
            batch = induce(batch, lead)
        batch = direct[bounds[lead] : bounds[lead + 1]]
        if len(batch):
            order.append(batch)
            induce(batch, lead)
    every = np.concatenate(order) if order else np.zeros(0, np.int64)
    return every[wanted[every]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For neighbours in the order: whether their common prefix has ``depth`` bytes."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        a = np.ascontiguousarray(word[left[alive] + at]).view(_U)[:, 0]
        b = np.ascontiguousarray(word[right[alive] + at]).view(_U)[:, 0]
        alive = alive[a == b]
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def repeated_starts(texts: list[bytes], owned: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Of each segment, the owned window starts whose window also starts at another place."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0] + [len(t) for t in texts])
    segment = np.repeat(np.arange(len(texts)), owned)
    within = np.arange(len(segment)) - np.repeat(np.cumsum(owned) - owned, owned)
    at = base[segment] + within
    wanted = np.zeros(len(text), bool)
    wanted[at] = True
    number = np.zeros(len(text), np.int64)
    number[at] = np.arange(len(at))
    where = place[segment].view(_U) + within.astype(_U)
    order = suffix_order(text, wanted)
    same = adjacent_prefixes(text, order)
    firsts = np.flatnonzero(np.concatenate([[True], ~same]))
    here = where[number[order]]
    several = np.minimum.reduceat(here, firsts) != np.maximum.reduceat(here, firsts)
    hit = number[order[np.repeat(several, np.diff(np.append(firsts, len(order))))]]
    hit.sort()
    cuts = np.searchsorted(segment[hit], np.arange(len(texts) + 1))
    return [within[hit[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]


def _spans(starts: np.ndarray, length: int = LENGTH) -> bytes:
    """Covered spans of window starts, as packed pairs of 32-bit integers."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + length], 1).astype("<i4").tobytes()


def _distinct(run: pa.RecordBatch) -> pa.RecordBatch:
    key = np.stack([run.column(0).to_numpy(), run.column(1).to_numpy()], 1)
    return run.take(pa.array(np.sort(np.unique(key, axis=0, return_index=True)[1])))


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns gram, content, place, owned, text; batches are sorted by gram."""
    for batch in _runs_of(batches, 0):
        batch = _distinct(batch)
        gram = batch.column(0).to_numpy()
        sizes = np.array([len(t) for t in batch.column(4).to_pylist()])
        ends = np.cumsum(sizes)
        cuts = np.append(np.flatnonzero(np.diff(gram)) + 1, len(gram))
        first = 0
        while first < len(gram):
            room = (ends[first - 1] if first else 0) + SORT_BYTES
            last = max(int(cuts[cuts > first][0]), int(cuts[np.searchsorted(cuts, np.searchsorted(ends, room), side="right") - 1])) if len(cuts) else len(gram)
            part = batch.slice(first, last - first)
            starts = repeated_starts(part.column(4).to_pylist(), part.column(3).to_numpy(), part.column(2).to_numpy())
            some = [i for i, s in enumerate(starts) if len(s)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some, pa.int64())), part.column(1).take(pa.array(some, pa.int64())), pa.array([_spans(starts[i]) for i in some], pa.binary())], names=["gram", "content", "spans"])
            first = last


def _windows_sent(owner_bits: int):
    """Pack the window hashes of hot grams' segments by owner; one more row per chunk says whose they are (owner -1)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task = TaskContext.get().partitionId() << 24
        for k, part in enumerate(slices(batches, "text", 4 << 20)):
            part = _distinct(part)
            owned = part.column(3).to_numpy()
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(m[s : s + LENGTH]) for t, c in zip(part.column(4).to_pylist(), owned.tolist()) for m in [memoryview(t)] for s in range(c)), _U, int(owned.sum()))
            segment = np.repeat(np.arange(len(owned)), owned)
            within = np.arange(len(segment)) - np.repeat(np.cumsum(owned) - owned, owned)
            where = part.column(2).to_numpy().view(_U)[segment] + within.astype(_U)
            owner = (hashes >> _U(64 - owner_bits)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange((1 << owner_bits) + 1))
            rows = [(-1, part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), owned.tobytes())]
            rows += [(o, hashes[i].tobytes(), where[i].tobytes(), i.astype(np.int64).tobytes()) for o in range(1 << owner_bits) if len(i := order[cuts[o] : cuts[o + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([task + k] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["chunk", "owner", "a", "b", "c"])

    return send


def _owned_windows(rows):
    """Of one owner: for each chunk the numbers of the windows that start at several places."""
    import pandas as pd

    hashes = np.concatenate([np.frombuffer(x, _U) for x in rows["a"]])
    where = np.concatenate([np.frombuffer(x, _U) for x in rows["b"]])
    number = np.concatenate([np.frombuffer(x, np.int64) for x in rows["c"]])
    chunk = np.repeat(rows["chunk"].to_numpy(), [len(x) // 8 for x in rows["a"]])
    order = np.argsort(hashes, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
    several = np.minimum.reduceat(where[order], firsts) != np.maximum.reduceat(where[order], firsts)
    hit = order[np.repeat(several, np.diff(np.append(firsts, len(order))))]
    out = [(int(c), number[hit[chunk[hit] == c]].tobytes()) for c in np.unique(chunk[hit])]
    return pd.DataFrame({"chunk": [c for c, _ in out], "hit": [h for _, h in out]})


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, c, hits in zip(*(x.to_pylist() for x in batch.columns)):
            gram, content, owned = (np.frombuffer(x, np.int64) for x in (a, b, c))
            hit = np.sort(np.concatenate([np.frombuffer(h, np.int64) for h in hits]))
            ends = np.cumsum(owned)
            cuts = np.searchsorted(hit, np.append(0, ends))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(content[some]), pa.array([_spans(hit[cuts[i] : cuts[i + 1]] - (ends[i] - owned[i])) for i in some], pa.binary())], names=["gram", "content", "spans"])


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values."""
    out, block, length, step, power = None, values, 0, 1, _BASE
    with np.errstate(over="ignore"):
        while step <= size:
            if size & step:
                n = len(values) - length - step + 1
                out = block if out is None else out[:n] * power + block[length : length + n]
                length += step
            block = block[:-step] * power + block[step:]
            power = power * power
            step *= 2
    return mix(out)


def _white_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each word between white space, and the bounds of rows in them; eight bytes of a word at a time."""
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    marks = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    first[marks], last[marks - 1] = inside[marks], inside[marks - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    hashes, some, at = size.astype(_U), np.arange(len(start)), 0
    while len(some):
        left = size[some] - at
        value = np.ascontiguousarray(eight[start[some] + at]).view(_U)[:, 0] & _LOW[np.minimum(left, 8)]
        hashes[some] = mix(hashes[some] * _BASE + value)
        some, at = some[left > 8], at + 8
    bounds = np.searchsorted(start, ends)
    return hashes, np.repeat(np.arange(len(ends) - 1), np.diff(bounds)), bounds


def _word_anchors(part: pa.RecordBatch):
    """Of a slice (doc_id, text): its word hashes and the row bounds in them; first word, row and gram of all windows, and where segments begin in those."""
    hashes, rows, bounds = _white_words(*buffers(part.column(1)))
    n, reach = len(hashes), SHARED - SHARED_GRAM + 1
    start = np.flatnonzero(rows[: n - SHARED + 1] == rows[SHARED - 1 :]) if n >= SHARED else np.zeros(0, np.int64)
    if not len(start):
        return hashes, bounds, start, start, start.view(_U), start
    gram = _rolled(hashes, SHARED_GRAM)
    least = (gram & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(gram), dtype=_U))
    least = _least_of(least, reach)
    anchor = (_U(0xFFFFFFFF) - (least & _U(0xFFFFFFFF))).astype(np.int64)[start]
    row = rows[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    return hashes, bounds, start, row, gram[anchor], first


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of each row, each once."""
    for part in slices(batches):
        _, _, _, row, gram, first = _word_anchors(part)
        row, gram = row[first], gram[first]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        once = np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(gram[once].view(np.int64))], names=["gram"])


def _windows_shipped(packed, bits: int):
    """Columns doc_id, row, tid, gram, ats, windows: the segments whose gram the filter holds; those of equal windows in a row are one, with all their places."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        filtered = packed.value
        for part in slices(batches):
            hashes, bounds, start, row, gram, first = _word_anchors(part)
            if not len(first):
                continue
            windows, owned = _rolled(hashes, SHARED)[start], np.diff(np.append(first, len(start)))
            place = (mix(gram[first]) >> _U(64 - bits)).astype(np.int64)
            some = np.flatnonzero((filtered[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
            first, owned, raw = first[some], owned[some], memoryview(windows.view(np.uint8))
            content = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * i : 8 * (i + n)]) for i, n in zip(first.tolist(), owned.tolist())), _U, len(first))
            at = (start[first] - bounds[row[first]]).astype("<i4")
            order = np.lexsort((content, row[first]))
            own, content = row[first][order], content[order]
            kinds = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), (own[1:] != own[:-1]) | (content[1:] != content[:-1])]))
            ends = np.append(kinds, len(own))
            ats = [at[order[a:b]].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            one = order[kinds]
            first, owned = first[one], owned[one]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(owned)), pa.int32()), pa.array(windows[np.repeat(first - (np.cumsum(owned) - owned), owned) + np.arange(owned.sum())].view(np.int64)))
            rows, texts = pa.array(row[first]), part.column(1)
            tids = {r: xxhash.xxh3_64_intdigest(texts[r].as_buffer()) for r in np.unique(row[first]).tolist()}
            tid = np.array([tids[r] for r in row[first].tolist()], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(2).take(rows), pa.array(tid), pa.array(gram[first].view(np.int64)), pa.array(ats, pa.binary()), lists], names=["doc_id", "row", "tid", "gram", "ats", "windows"])

    return ship


def _of_windows(run: pa.RecordBatch, several: np.ndarray, owned: np.ndarray) -> pa.RecordBatch:
    """Columns doc_id, tid, ats, spans of a run's segments: what the windows that are set cover."""
    hit = np.flatnonzero(several)
    some, counts = np.unique(np.repeat(np.arange(len(owned)), owned)[hit], return_counts=True)
    within = hit - np.repeat((np.cumsum(owned) - owned)[some], counts)
    bounds = np.append(0, np.cumsum(counts)).tolist()
    spans = pa.array([_spans(within[a:b], SHARED) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([*(run.column(c).take(pa.array(some)) for c in ("doc_id", "tid", "ats")), spans], names=["doc_id", "tid", "ats", "spans"])


def _holders(windows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct windows, ascending, the least and the greatest row that holds each, and the number of each given window among them."""
    kinds, number = np.unique(windows, return_inverse=True)
    order = np.argsort(number, kind="stable")
    firsts = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), np.diff(number[order]) != 0]))
    return kinds, np.minimum.reduceat(low[order], firsts), np.maximum.reduceat(high[order], firsts), number


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns gram, doc_id, row, tid, ats, windows; batches are sorted by gram: the windows that several rows hold."""
    for run in _runs_of(batches, 0):
        windows, owned = run.column(5).flatten().to_numpy(), pc.list_value_length(run.column(5)).to_numpy()
        holder = np.repeat(run.column(2).to_numpy(), owned)
        _, low, high, number = _holders(windows, holder, holder)
        yield _of_windows(run, (low != high)[number], owned)


def _shared_sent(owner_bits: int):
    """Of hot grams' segments: the distinct windows of a batch with their least and greatest row, packed by owner; one more row (owner -1) keeps the segments."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for k, batch in enumerate(b for b in batches if b.num_rows):
            lists = batch.column(batch.schema.get_field_index("windows"))
            windows, owned = lists.flatten().to_numpy().view(_U), pc.list_value_length(lists).to_numpy()
            holder = np.repeat(batch.column(batch.schema.get_field_index("row")).to_numpy(), owned)
            kinds, low, high, number = _holders(windows, holder, holder)
            cuts = np.searchsorted(kinds >> _U(64 - owner_bits), np.arange((1 << owner_bits) + 1, dtype=_U)).tolist()
            own = batch.select(["doc_id", "tid", "ats"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_batch(own)
            rows = [(-1, sink.getvalue().to_pybytes(), owned.astype("<i4").tobytes(), number.astype("<i4").tobytes(), len(kinds))]
            rows += [(o, kinds[a:b].tobytes(), low[a:b].tobytes(), high[a:b].tobytes(), a) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([task + k] * len(rows), pa.int64()), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], names=["chunk", "owner", "a", "b", "c", "n"])

    return send


def _shared_owned(rows):
    """Of one owner: for each chunk the numbers of the windows that several rows hold."""
    import pandas as pd

    windows, low, high = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("a", _U), ("b", np.int64), ("c", np.int64)))
    sizes = [len(x) // 8 for x in rows["a"]]
    _, low, high, number = _holders(windows, low, high)
    flags = np.split((low != high)[number], np.cumsum(sizes)[:-1])
    hits = [(c, (n + np.flatnonzero(f)).astype("<i4").tobytes()) for c, n, f in zip(rows["chunk"].tolist(), rows["n"].tolist(), flags) if f.any()]
    return pd.DataFrame({"chunk": [c for c, _ in hits], "hit": [h for _, h in hits]})


def _shared_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, c, n of a chunk's segments, and its hits."""
    for batch in batches:
        for own, owned, number, n, hits in zip(*(x.to_pylist() for x in batch.columns)):
            several = np.zeros(n, bool)
            several[np.frombuffer(b"".join(hits), "<i4")] = True
            run = pa.ipc.open_stream(own).read_next_batch()
            yield _of_windows(run, several[np.frombuffer(number, "<i4")], np.frombuffer(owned, "<i4").astype(np.int64))


def _shared_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, tid, list of struct ats, spans: the words that the spans cover at all places."""
    for batch in batches:
        counts = []
        for found in batch.column(2).to_pylist():
            pairs = np.concatenate([(np.frombuffer(f["spans"], "<i4").reshape(-1, 2) + np.frombuffer(f["ats"], "<i4")[:, None, None]).reshape(-1, 2) for f in found])
            pairs = pairs[np.argsort(pairs[:, 0])]
            reached = np.maximum.accumulate(pairs[:, 1])
            counts.append(int((reached - np.maximum(pairs[:, 0], np.append(0, reached[:-1]))).clip(0).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "tid", "shared"])


def shared_passages(slim: DataFrame) -> DataFrame:
    """doc_id, tid, shared: the words in runs of SHARED or more that another row holds as well."""
    spark = slim.sparkSession
    grams = written(slim.mapInArrow(_shared_grams, "gram long").groupBy("gram").count().where("count > 1"), "passage_grams")
    bits = min(FILTER_BITS, max(16, (grams.count() * 24).bit_length()))
    packed = spark.sparkContext.broadcast(_filter_of(grams.select("gram"), bits))
    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    shipped = written(numbered.mapInArrow(_windows_shipped(packed, bits), "doc_id long, row long, tid long, gram long, ats binary, windows array<long>"), "passages")
    hot = grams.where(f"count > {RUN_SEGMENTS}").select("gram")
    some_hot = not hot.isEmpty()
    cold = shipped.join(F.broadcast(hot), "gram", "left_anti") if some_hot else shipped
    schema = "doc_id long, tid long, ats binary, spans binary"
    found = cold.select("gram", "doc_id", "row", "tid", "ats", "windows").repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared_runs, schema)
    if some_hot:
        many = shipped.join(F.broadcast(hot), "gram", "left_semi")
        owner_bits = max(4, (many.count() // 20_000).bit_length())
        sent = written(many.mapInArrow(_shared_sent(owner_bits), "chunk long, owner int, a binary, b binary, c binary, n long"), "passage_windows")
        hits = sent.where("owner >= 0").groupBy("owner").applyInPandas(_shared_owned, "chunk long, hit binary").groupBy("chunk").agg(F.collect_list("hit").alias("hits"))
        found = found.union(sent.where("owner < 0").join(hits, "chunk").select("a", "b", "c", "n", "hits").mapInArrow(_shared_told, schema))
    spans = found.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("ats", "spans")).alias("s"))
    return spans.mapInArrow(_shared_counted, "doc_id long, tid long, shared long")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, found (list of struct tid, ats, spans, shared): cut the text."""
    import xxhash

    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_buffer().to_pybytes()
            n, edge, shared = len(raw), None, 0
            mine = [f for f in found or () if f["tid"] == np.array(xxhash.xxh3_64_intdigest(raw), _U).view(np.int64)]
            if mine:
                edge = np.zeros(n + 1, np.int32)
                for f in mine:
                    shared = max(shared, f["shared"])
                    pairs = np.frombuffer(b"".join(f["spans"]), "<i4").reshape(-1, 2) + np.repeat(np.array(f["ats"], np.int64), [len(x) // 8 for x in f["spans"]])[:, None]
                    edge += np.bincount(pairs[:, 0], minlength=n + 1).astype(np.int32) - np.bincount(pairs[:, 1], minlength=n + 1).astype(np.int32)
            gone = np.cumsum(edge[:n]) > 0 if edge is not None else np.zeros(n, bool)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
            runs = int(gone[:1].sum() + ((~gone[:-1]) & gone[1:]).sum())
            out.append((doc_id, n, int(gone.sum()), runs, kept, shared))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared_words")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=list(names))


def _filter_of(places: DataFrame, bits: int) -> np.ndarray:
    """One bit for each place; tasks make parts of at most 2**bits bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for b in batches:
            flags[(mix(b.column(0).to_numpy().view(_U)) >> _U(64 - bits)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()])], names=["part"])

    packed = np.zeros((1 << bits) >> 3, np.uint8)
    for part in places.coalesce(8).mapInArrow(make, "part binary").toLocalIterator():
        packed |= np.frombuffer(part[0], np.uint8)
    return packed


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    With ``passages`` also n_shared_words: the words in runs of SHARED or more that another row
    holds as well, whether they are long enough to be removed or not.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(slim.mapInArrow(_anchored, "doc_id long, tid long, gram long, content long, place long, at long, owned long"), "segments")
    # A text that several rows hold goes as a whole; each row has exactly one segment that starts at 0.
    copies = rows.where("at = 0").groupBy("tid").count().where("count > 1").select("tid")
    kinds = rows.groupBy("gram", "content").agg(F.min("place").alias("place"), F.max("place").alias("other"), F.min("owned").alias("owned"))
    kinds = written(kinds, "kinds")
    grams = kinds.groupBy("gram").count().where("count > 1")
    mixed = written(kinds.join(grams, "gram").select("gram", "content", "place", "count"), "mixed")
    bits = min(FILTER_BITS, max(16, (mixed.count() * 24).bit_length()))
    packed = spark.sparkContext.broadcast(_filter_of(mixed.select("place"), bits))
    shipped = written(slim.mapInArrow(_shipped(packed, bits), "gram long, content long, place long, owned long, text binary"), "shipped")
    hot = grams.where(f"count > {RUN_SEGMENTS}").select("gram")
    schema = "gram long, content long, spans binary"
    cold = shipped.join(hot, "gram", "left_anti") if not hot.isEmpty() else shipped
    found = cold.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_runs, schema)
    if not hot.isEmpty():
        many = shipped.join(hot, "gram", "left_semi")
        owner_bits = max(4, (many.count() // 4_000).bit_length())
        sent = written(many.repartition(F.xxhash64("gram", "content")).mapInArrow(_windows_sent(owner_bits), "chunk long, owner int, a binary, b binary, c binary"), "windows")
        hits = sent.where("owner >= 0").groupBy("owner").applyInPandas(_owned_windows, "chunk long, hit binary").groupBy("chunk").agg(F.collect_list("hit").alias("hits"))
        told = sent.where("owner < 0").join(hits, "chunk").select("a", "b", "c", "hits").mapInArrow(_told, schema)
        found = found.union(told)
    known = kinds.where("place != other").select("gram", "content", _pair(F.col("owned")).alias("spans")).union(found)
    per_segment = rows.join(copies, "tid", "left_anti").join(known, ["gram", "content"]).select("doc_id", "tid", "at", "spans")
    all_of = rows.join(copies, "tid", "left_semi").select("doc_id", "tid", "at", _pair(F.col("owned")).alias("spans"))
    found = per_segment.union(all_of).select("doc_id", "tid", F.struct("at", "spans").alias("x"), F.lit(0).cast("long").alias("shared"))
    if passages:
        found = found.union(shared_passages(slim).select("doc_id", "tid", F.lit(None).cast("struct<at:long,spans:binary>"), "shared"))
    found = found.groupBy("doc_id", "tid").agg(F.collect_list("x").alias("s"), F.max("shared").alias("shared"))
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("tid", F.col("s.at").alias("ats"), F.col("s.spans").alias("spans"), "shared")).alias("found"))
    found = written(found.withColumnRenamed("doc_id", "_id"), "found")
    spans = lambda x: F.aggregate(x["spans"], F.lit(24).cast("long"), lambda n, s: n + 32 + F.octet_length(s))
    size = found.agg(F.sum(F.aggregate("found", F.lit(32).cast("long"), lambda n, x: n + spans(x)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    joined = slim.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "found")
    out = joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared_words long")
    return out if passages else out.drop("n_shared_words")


def _pair(owned, length: int = LENGTH):
    """Packed span from 0 to the end of a segment of that many windows."""
    text = F.lpad(F.hex(owned + F.lit(length - 1)), 8, "0")
    little = F.concat(*(F.substring(text, k, 2) for k in (7, 5, 3, 1)))
    return F.unhex(F.concat(F.lit("00000000"), little))


def digests(kept: DataFrame) -> DataFrame:
    """The digest columns of remove_repeats' rows; three more say again whether and how much a text changes, and shared words follow if they were counted."""
    removed, counted = F.col("n_removed"), [c for c in kept.columns if c == "n_shared_words"]
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - removed).alias("n_kept"), (removed / F.greatest("n_bytes", F.lit(1))).alias("removed_share"), (removed > 0).alias("repeated"), *counted,
    )
